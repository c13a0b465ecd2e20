"""Overlaps of two texts against a plain version; SQL takes too long for it on whole texts."""

from __future__ import annotations

from collections import Counter

from corvia.plans.packets import overlaps


def plain(a: str | None, b: str | None) -> tuple[float, str]:
    x, y = ({" ".join(line.split()) for line in (t or "").split("\n")} - {""} for t in (a, b))
    n = min(len(x), len(y))
    lines = len(x & y) / n if n else 1.0
    if not n or n >= 4 or lines >= 0.3:
        return lines, "lines"
    g, h = (Counter(zip(s, s[1:])) for s in ("".join((t or "").split()) for t in (a, b)))
    least = min(g.total(), h.total())
    return (max(lines, (g & h).total() / least) if least else 1.0), "pairs"


def test_overlaps(spark):
    texts = [None, "", "a", "one line of text", "one  line of texts", "a\nb\nc\nd\ne", "a\nb\nc\nx\ny", "p\nq\nr\ns", "one line\nof \U0001f600 text", " \n ", "ab" * 20000, "ba" * 20000 + "c"]
    rows = [(i * 100 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    found = overlaps(spark.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b").collect()
    assert {r.k: (round(r.overlap, 9), r.by) for r in found} == {k: (round(plain(a, b)[0], 9), plain(a, b)[1]) for k, a, b in rows}
