"""Clauses around a span, and whether a protective word governs it there."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from corvia.plans.catalog import Protection

#: What ends a sentence, and how much of it is looked at on either side of a span.
SENTENCE_END, REACH = r"[.!?]\s|\n", 200

_MARK = re.compile(SENTENCE_END)
_compiled = lru_cache(256)(re.compile)


class Sentences:
    """The sentence ends of a text, found once for all of its spans."""

    def __init__(self, text: str):
        self.text, self.ends = text, [m.end() for m in _MARK.finditer(text)]

    def around(self, start: int, end: int) -> tuple[str, str]:
        """What comes before and after a span in its sentence."""
        before = bisect_right(self.ends, start)
        low = max(self.ends[before - 1] if before else 0, start - REACH)
        stop = _MARK.search(self.text, end, end + REACH)
        return self.text[low:start], self.text[end : stop.start() if stop else end + REACH]


def words(text: str) -> int:
    return len(text.split())


def clause(left: str, span: str, right: str, breaks: str, item_words: int) -> tuple[str, str]:
    """What comes before and after a span in its clause.

    Breaks end a clause, and so do commas, unless they join the items of a list, which have ``item_words``
    words or fewer; the first item may have more before it.
    """
    left, right = _compiled(breaks).split(left)[-1], _compiled(breaks).split(right)[0]
    before, after = left.split(","), right.split(",")
    if words(before[-1] + span + after[0]) <= item_words:
        longer = [i for i, x in enumerate(before[:-1]) if words(x) > item_words]
        left = ",".join(before[longer[-1] if longer else 0 :])
    else:
        left = before[-1]
    stop = next((i for i, x in enumerate(after) if i and words(x) > item_words), len(after))
    return left, ",".join(after[:stop])


def padded(text: str) -> str:
    """With the blanks that governors have around them."""
    return f" {text} "


def distance(pattern: str, left: str, right: str) -> int | None:
    """Characters between the span and the nearest match in its clause."""
    before, after = _compiled(pattern).split(padded(left)), _compiled(pattern).split(padded(right))
    near = ([len(before[-1])] if len(before) > 1 else []) + ([len(after[0])] if len(after) > 1 else [])
    return min(near, default=None)


def governed(sentences: Sentences, start: int, end: int, p: Protection) -> bool:
    """Whether the span is protected.

    A word of indifference after it in its clause protects it, unless a contrast follows in the sentence.
    Else the nearest governor of the clause decides: a protective word protects, a requirement does not;
    at one distance the protective word counts.
    """
    before, after = sentences.around(start, end)
    left, right = clause(before, sentences.text[start:end], after, p.breaks, p.item_words)
    if m := _compiled(p.indifferent).search(padded(right)):
        return not _compiled(p.contrast).search(padded(after)[m.end() - 1 :])
    protect, require = distance(p.protect, left, right), distance(p.require, left, right)
    return protect is not None and (require is None or protect <= require)
