"""Composed views against a character-by-character version, and protective clauses against a plain scanner."""

from __future__ import annotations

import random
import re
import tracemalloc
import unicodedata
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvia.functions.text import SPACES, WIDE, ZERO_WIDTH
from corvia.functions.views import ENDINGS, ending_view, is_plain, match_view, nfkc_text, normal_view, same
from corvia.operators.clauses import Sentences, governed
from corvia.operators.rules import check, match_text, presence_rules, rule_matches, scanned
from corvia.plans.catalog import DEFAULT, GUARDED, NEGATIONS, CatalogError, Protection, Rule

PARTS = ["ization", "ized", "ation", "ungen", "iones", "a", "Xé", "ﬁ", "０", "​", " ", " ", "①", "½", "\n", " ", ".", "@", "é", "Ǆ"]


def plain_view(text: str) -> list[tuple[str, int, int]]:
    """Characters with the source they stand for: normalised one by one, then rewritten where the first fitting ending stands."""
    chars = []
    for i, c in enumerate(text):
        new = "" if c in "​‌‍﻿" else c if c in "\t\r\n" else " " if c.isspace() else unicodedata.normalize("NFKC", c)
        chars += [(x, i, i + 1) for x in new]
    letters, out, at = "".join(c for c, _, _ in chars), [], 0
    while at < len(chars):
        for old, new in ENDINGS:
            after = letters[at + len(old) : at + len(old) + 1]
            if letters.startswith(old, at) and not re.match("[a-zA-ZÀ-ÿ]", after):
                out += [(x, chars[at][1], chars[at + len(old) - 1][2]) for x in new]
                at += len(old)
                break
        else:
            out.append(chars[at])
            at += 1
    return out


def test_views_compose():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choices(PARTS, k=rng.randrange(12)))
        view = same(text).then(normal_view).then(ending_view)
        assert list(zip(view.text, view.starts, view.ends)) == plain_view(text)
        assert len(view.text) == len(view.starts) == len(view.ends)


def spelled_out(n: int, stretches) -> list[tuple[int, int]]:
    """The source of each of a view's characters, one by one, from its stretches."""
    out = []
    for at, until, start, end in (*zip(*map(list, stretches)), (n, n, 0, 0)):
        out += [(x, x + 1) for last in [out[-1][1] if out else 0] for x in range(last, last + at - len(out))]
        out += [(start, end)] * (until - at)
    return out


def test_stretches_say_where_each_character_stands():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices(PARTS, k=rng.randrange(12)))
        view = same(text).then(normal_view).then(ending_view)
        assert spelled_out(len(view.text), view.stretches()) == [(start, end) for _, start, end in plain_view(text)]


def test_match_view_costs_by_edits_not_by_characters(spark):
    texts = ["word " * 600 + end for end in ("", "organization", "０１２", "a​b ﬁt") for _ in range(100)]
    tracemalloc.start()
    found = match_view.func(pd.Series(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * sum(map(len, texts))
    assert [tuple(map(list, r[1:])) for r in found.itertuples(index=False)][::100] == [([], [], [], []), ([3005], [3012], [3005], [3012]), ([], [], [], []), ([3001, 3003], [3002, 3005], [3002, 3004], [3003, 3005])]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "an organ​ization")], "doc_id long, text string")
    rows = docs.select(match_view("text").alias("v")).select("v.*").collect()
    assert [tuple(r) for r in rows] == [(None, [], [], [], []), ("", [], [], [], []), ("an organisation", [8], [15], [9], [16])]


def test_first_rule_wins_at_one_place():
    assert ending_view("xab", (("ab", "1"), ("b", "22"))).text == "x1"
    view = ending_view("xab yb", (("b", "22"), ("ab", "1"), ("b", "3")))
    assert view.text == "x1 y22" and view.span(1, 2) == (1, 3) and view.span(4, 5) == (5, 6)


def test_plain_texts(spark):
    rows = [("plain é",), ("ﬁ",), (" ",), ("Ǆ",), ("０",), ("",)]
    found = {r.text: r.p for r in spark.createDataFrame(rows, "text string").select("text", is_plain(F.col("text")).alias("p")).collect()}
    assert found == {t: normal_view(t).text == t for (t,) in rows}


def test_texts_are_normalised_in_the_engine_as_by_character(spark):
    chars = [chr(i) for i in range(0x2FF)] + list(SPACES + WIDE + ZERO_WIDTH) + [chr(i) for i in range(0x2000, 0x2070)] + PARTS + ["中", "\U0001d7d8", "e\u0301"]
    rows = [(c,) for c in chars] + [("a" + c + "１",) for c in chars] + [("",), (None,)]
    found = spark.createDataFrame(rows, "text string").repartition(4).select("text", nfkc_text(F.col("text")).alias("n")).collect()
    assert len(found) == len(rows)
    assert [(r.text, r.n) for r in found if r.n != (None if r.text is None else normal_view(r.text).text)] == []


def test_scans_hand_on_what_they_hold(spark):
    rules = presence_rules(DEFAULT)
    texts = ["a@b.org " * 1000] * 100
    batch = pd.DataFrame({"text": [*texts, None], "numbers": [[0]] * 100 + [[]]})
    tracemalloc.start()
    sizes = [len(part) for part in scanned(iter([batch]), rules)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 101 and peak < 20e6
    docs = spark.createDataFrame(list(enumerate(texts)) + [(100, None), (101, ""), (102, "x@y.org")], "doc_id long, text string").coalesce(1)
    found = {r.doc_id: (r.n, r.first) for r in rule_matches(docs, DEFAULT).where(F.col("rule_id") == rules[0].id).select("doc_id", F.size("candidates").alias("n"), F.col("candidates")[0]["txt"].alias("first")).collect()}
    assert found == {i: (1000, "a@b.org") for i in range(100)} | {102: (1, "x@y.org")}


def test_rules_see_views(spark):
    rule = Rule("Q-X", "question", "x", "low", "presence", ("organization", "re:[0-9]{3}"), exclude=DEFAULT.rules[0].exclude)
    text = "An organ​ization, and １２３, and 456"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    catalog = replace(DEFAULT, rules=(*DEFAULT.rules, rule))
    seen = lambda views: {r.doc_id: [(s.start, s.end, s.txt) for s in r.candidates] for r in rule_matches(docs, catalog, views=views).where("rule_id = 'Q-X'").collect()}
    assert seen(True) == {1: [(3, 16, "organ​ization"), (22, 25, "１２３"), (31, 34, "456")]}
    assert seen(False) == {1: [(31, 34, "456")]}


def scan(text: str, start: int, end: int, p: Protection) -> bool:
    """The clause of a span found by walking outwards one character at a time, and its governors by trying every place."""
    low = start
    while low > 0 and start - low < 200 and not re.fullmatch(r"[.!?]\s|\n|[.!?]\n", text[max(low - 2, 0) : low]) and text[low - 1] != "\n":
        low -= 1
    high = end
    while high < len(text) and high - end < 200 and text[high] != "\n" and not (text[high] in ".!?" and high + 1 < min(len(text), end + 200) and text[high + 1].isspace()):
        high += 1
    before, after = text[low:start], text[end:high]
    cut = [m.end() for m in re.finditer(p.breaks, before)]
    left = before[cut[-1] :] if cut else before
    cut = [m.start() for m in re.finditer(p.breaks, after)]
    right = after[: cut[0]] if cut else after
    items, more = left.split(","), right.split(",")
    short = lambda x: len(x.split()) <= p.item_words
    kept = [items.pop()]
    if short(kept[0] + text[start:end] + more[0]):
        while items:
            kept.insert(0, items.pop())
            if not short(kept[0]):
                break
    rest = [more.pop(0)]
    while more and short(more[0]):
        rest.append(more.pop(0))
    left, right = f" {','.join(kept)} ", f" {','.join(rest)} "
    if m := re.search(p.indifferent, right):
        return not re.search(p.contrast, f" {after} "[m.end() - 1 :])

    def nearest(rx: str) -> float:
        ends, starts = [m.end() for m in re.finditer(rx, left)], [m.start() for m in re.finditer(rx, right)]
        return min([len(left) - ends[-1]] if ends else [], default=float("inf")), min(starts, default=float("inf"))

    protect, require = min(nearest(p.protect)), min(nearest(p.require))
    return protect < float("inf") and protect <= require


def test_clauses_against_a_plain_scanner():
    rng = random.Random(2)
    words = ["no", "not", "must", "only", "all", "but", "or", "a", "bb", "ccc", "item", "names", "and"]
    marks = [" ", " ", " ", " ", ", ", ", ", ". ", "; ", ": ", "\n", ".x"]
    n = 0
    for _ in range(4000):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(2, 30)))
        spans = [m.span() for m in re.finditer("names|item", text)]
        sentences = Sentences(text)
        for span in spans:
            assert governed(sentences, *span, NEGATIONS) == scan(text, *span, NEGATIONS), (text, span)
            n += governed(sentences, *span, NEGATIONS)
    assert n > 500


@pytest.mark.parametrize(
    "text, protected",
    [
        ("We take no names, mails a@b.org, or numbers.", True), ("Send your mail a@b.org now. We take no calls.", False), ("Not today; write to a@b.org", False),
        ("no x, you must write to a@b.org", False), ("write to a@b.org, not to the other of them", False), ("write to a@b.org, not c", True), ("a@b.org all the day", True), ("a@b.org all the day, but only once", False), ("a@b.org all day or night but", False),
    ],
)
def test_a_veto_changes_the_check(spark, text, protected):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found, plain = check(docs, GUARDED).first(), check(docs, DEFAULT).first()
    assert [f.rule_id for f in plain.findings] == ["P-MAIL"]
    assert [f.rule_id for f in found.findings] == ([] if protected else ["P-MAIL"])
    assert ("P-MAIL" in found.suppressed) == protected


def test_many_candidates_in_one_sentence_are_linear():
    text = "no a@b.org " * 20000
    found, left = match_text(text, next(r for r in GUARDED.rules if r.id == "P-MAIL"))
    assert len(found) == 20000 and not left


def test_governors_are_checked():
    bad = replace(NEGATIONS, protect="(no)")
    with pytest.raises(CatalogError, match="groups"):
        DEFAULT.with_local([Rule("Q-Z", "question", "x", "low", "presence", ("a",), protect=bad)])
    assert GUARDED.matching_version != DEFAULT.matching_version
