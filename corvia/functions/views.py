"""Views of a text whose characters map back to the source, for texts where normalisation or rewriting changes lengths.

A view is its text and, for each of its characters, where the source it stands for starts and ends. Views
compose, so that a span of the last is a span of the first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvia.functions.text import IDENTIFIERS, SPACES, ZERO_WIDTH, masked, normalized

#: Characters that per-character normalisation may change.
_CHANGEABLE = re.compile("[^\t\n\r\x20-\x7e]")

#: Endings and what they are rewritten to; at one place the first that fits counts.
ENDINGS = (("ization", "isation"), ("izing", "ising"), ("ized", "ised"), ("ation", "ate"), ("ements", "ement"), ("ungen", "ung"), ("iones", "ión"))


@dataclass(frozen=True)
class View:
    """Character ``i`` of ``text`` stands for the source's ``[starts[i], ends[i])``."""

    text: str
    starts: Sequence[int]
    ends: Sequence[int]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source of a span of the view that is not empty."""
        return int(self.starts[start]), int(self.ends[end - 1])

    def then(self, change) -> View:
        """The view that ``change`` makes of this one's text, mapped to this one's source."""
        after = change(self.text)
        if after.text == self.text:
            return self
        if isinstance(self.starts, range):
            return after
        return View(after.text, self.starts[after.starts], self.ends[after.ends - 1])

    def stretches(self) -> np.ndarray:
        """``at, until, start, end`` in rows, with a column for each of the view's ``[at, until)`` whose characters share the source's ``[start, end)``; of all other characters, each stands for one, next to what the one before it stands for (the first for the source's first)."""
        if isinstance(self.starts, range) or not self.text:
            return np.empty((4, 0), "int32")
        at = np.flatnonzero(np.r_[True, (self.starts[1:] != self.starts[:-1]) | (self.ends[1:] != self.ends[:-1])])
        until, start, end = np.r_[at[1:], len(self.text)], self.starts[at], self.ends[at]
        odd = (until - at > 1) | (end - start > 1) | (start != np.r_[0, end[:-1]])
        return np.stack((at, until, start, end))[:, odd].astype("int32")


def same(text: str) -> View:
    return View(text, range(len(text)), range(1, len(text) + 1))


def replaced(text: str, edits: list[tuple[int, int, str]]) -> View:
    """The view with each ``(start, end, new)`` in place, edits in order and apart; every character of ``new`` stands for the whole of what it replaces."""
    if not edits:
        return same(text)
    pieces, counts, firsts, at = [], [], [], 0
    for start, end, new in (*edits, (len(text), len(text), "")):
        pieces += [text[at:start], new]
        counts += [start - at, len(new)]
        firsts += [at, start]
        at = end
    counts = np.array(counts, "int32")
    starts = np.repeat(np.array(firsts, "int32"), counts)
    kept = np.repeat(np.tile([True, False], len(counts) // 2), counts)
    starts[kept] += (np.arange(len(starts), dtype="int32") - np.repeat(np.cumsum(counts, dtype="int32") - counts, counts))[kept]
    ends = starts + 1
    ends[~kept] = np.repeat(np.array([end for _, end, _ in edits], "int32"), counts[1:-1:2])
    return View("".join(pieces), starts, ends)


@lru_cache(1 << 16)
def nfkc_char(c: str) -> str:
    """One character on its own: never composed with its neighbours."""
    if c in ZERO_WIDTH:
        return ""
    if c in "\t\r\n":
        return c
    return " " if c in SPACES or c.isspace() else unicodedata.normalize("NFKC", c)


def normal_view(text: str) -> View:
    """Per-character NFKC."""
    edits = [(m.start(), m.end(), nfkc_char(m[0])) for m in _CHANGEABLE.finditer(text)]
    return replaced(text, [e for e in edits if e[2] != text[e[0]]])


@lru_cache(16)
def _endings(rules: tuple[tuple[str, str], ...]) -> tuple[re.Pattern, dict[str, str]]:
    targets: dict[str, str] = {}
    for old, new in rules:
        targets.setdefault(old, new)
    return re.compile(f"(?:{'|'.join(map(re.escape, targets))})(?![a-zA-ZÀ-ÿ])"), targets


def ending_view(text: str, rules: tuple[tuple[str, str], ...] = ENDINGS) -> View:
    """Words with their endings rewritten, in one pass from the left."""
    pattern, targets = _endings(rules)
    return replaced(text, [(*m.span(), targets[m[0]]) for m in pattern.finditer(text)])


INTS = T.ArrayType(T.IntegerType())


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(k, INTS) for k in ("at", "until", "starts", "ends"))]))
def match_view(texts: pd.Series) -> pd.DataFrame:
    """The normalised text with its endings rewritten, and its stretches (:meth:`View.stretches`), from which the source of each of its characters follows: a few numbers an edit, none for other characters."""

    def row(text: str | None) -> tuple:
        view = same("") if text is None else normal_view(text).then(ending_view)
        return (None if text is None else view.text, *view.stretches())

    return pd.DataFrame([row(x) for x in texts], columns=["text", "at", "until", "starts", "ends"])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("starts", INTS)]))
def nfkc_view(texts: pd.Series) -> pd.DataFrame:
    """Per-character NFKC and, for each character of the view, its source offset."""
    views = [None if x is None else normal_view(x) for x in texts]
    return pd.DataFrame([(None, None) if v is None else (v.text, np.asarray(v.starts, "int32")) for v in views], columns=["text", "starts"])


def is_plain(text: Column) -> Column:
    """True of texts that normalisation leaves as they are: they need no view."""
    return ~text.rlike(r"[^\x00-\x7FÀ-ÿ]") & (normalized(text) == text)


def nfkc_text(text: Column) -> Column:
    """Per-character NFKC without offsets; texts of characters that normalisation leaves or takes back one by one stay in the JVM."""

    @F.pandas_udf(T.StringType())
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _CHANGEABLE.sub(lambda m: nfkc_char(m[0]), x), na_action="ignore")

    kept, beyond = ~text.rlike(r"[^\t\n\r\x20-\x7EÀ-ÿ]"), normalized(text).rlike(r"[^\x00-\x7FÀ-ÿ]")
    return F.when(kept, text).when(~beyond, normalized(text)).otherwise(nfkc(F.when(~kept & beyond, text)))


def has_ending(text: Column, rules: tuple[tuple[str, str], ...] = ENDINGS) -> Column:
    return text.rlike(_endings(rules)[0].pattern)


@lru_cache(64)
def _identifiers(patterns: tuple[tuple[str, str], ...]) -> list[tuple[str, re.Pattern]]:
    return [(kind, re.compile(p)) for kind, p in patterns]


def mask_view(text: str, patterns: dict[str, str]) -> str:
    """The text with what its normalised view shows of each kind masked, kind by kind, where it stands."""
    for kind, pattern in _identifiers(tuple(patterns.items())):
        view = normal_view(text)
        text = replaced(text, [(*view.span(*m.span()), f"[{kind}]") for m in pattern.finditer(view.text)]).text
    return text


def masked_in_view(text: Column, patterns: dict[str, str] = IDENTIFIERS) -> Column:
    """Identifiers masked, also such as are written in look-alike characters or with zero-width ones in them; plain texts stay in the JVM."""

    @F.pandas_udf(T.StringType())
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: mask_view(x, patterns), na_action="ignore")

    return F.when(is_plain(text), masked(text, patterns)).otherwise(mask(F.when(~is_plain(text), text)))
