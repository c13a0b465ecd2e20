"""Line alignments against the full table, ordered digests, order statistics, tracked spans and nested blocks against plain versions."""

from __future__ import annotations

import json
import math
import random
import re
import statistics
import time

import pytest
from pyspark.sql import functions as F

from corvia.functions.edits import MASKS, masked_with_span
from corvia.operators.blocks import block_lines
from corvia.operators.lines import common_length, differences, line_differences
from corvia.operators.order import BASE, PRIME, joined, medians, order_statistics, ordered_digest, percentiles


def table_walk(a: list, b: list) -> tuple[list, list]:
    """The whole table of suffix lengths, walked from the front; equal ends are taken off first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in reversed(range(len(x))):
        for j in reversed(range(len(y))):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    removed, added = [], []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            removed.append(head + i)
            i += 1
        else:
            added.append(head + j)
            j += 1
    return removed, added


def test_differences_against_the_table():
    rng = random.Random(1)
    for n in range(600):
        letters = "ab" if n % 2 else "abcdef"
        a, b = rng.choices(letters, k=rng.randrange(40)), rng.choices(letters, k=rng.randrange(40))
        assert differences(a, b) == table_walk(a, b)
        removed, added = differences(a, b)
        assert [x for i, x in enumerate(a) if i not in removed] == [x for j, x in enumerate(b) if j not in added]
        assert len(a) - len(removed) == common_length(a, b)


def test_differences_of_long_versions():
    rng = random.Random(2)
    a = [str(rng.randrange(400)) for _ in range(6000)]
    b = [x for x in a if rng.random() > 0.1] + ["end"]
    began = time.perf_counter()
    removed, added = differences(a, b)
    assert len(a) - len(removed) == len(b) - len(added) == common_length(a, b)
    assert time.perf_counter() - began < 20


def test_line_differences(spark):
    rows = [(1, ["a  b", "", "c"], ["a b", "d ", " "]), (2, None, ["x"]), (3, [], []), (4, ["x", "x"], ["x"]), (5, [" y"], None)]
    found = spark.createDataFrame(rows, "id int, old array<string>, new array<string>").select("id", F.explode(line_differences("old", "new")).alias("d")).select("id", "d.*").collect()
    assert sorted(map(tuple, found)) == [(1, "added", 1, "d"), (1, "removed", 2, "c"), (2, "added", 0, "x"), (4, "removed", 1, "x"), (5, "removed", 0, "y")]


def test_ordered_digest(spark):
    rows = [(i, f"row {i * 7 % 31}") for i in range(500)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    base = ordered_digest(df, ["id"], F.col("text")).first()
    assert base.n == 502
    for parts in (1, 3, 17):
        assert ordered_digest(df.repartition(parts), ["id"], F.col("text")).first() == base
    swapped = [(i, rows[{3: 4, 4: 3}.get(i, i)][1]) for i in range(502)]
    assert ordered_digest(spark.createDataFrame(swapped, df.schema), ["id"], F.col("text")).first().digest != base.digest
    unnull = [(i, t or "") for i, t in rows]
    assert ordered_digest(spark.createDataFrame(unnull, df.schema), ["id"], F.col("text")).first().digest != base.digest
    assert tuple(ordered_digest(df.limit(0), ["id"], F.col("text")).first()) == (0, 0)


def test_digests_join_like_a_monoid():
    rng = random.Random(3)
    runs = [(n := rng.randrange(5), rng.randrange(PRIME) if n else 0) for _ in range(30)]
    for a, b, c in zip(runs, runs[1:], runs[2:]):
        assert joined(joined(a, b), c) == joined(a, joined(b, c)) and joined((0, 0), a) == a == joined(a, (0, 0))
    assert joined((1, 5), (1, 6)) == (2, (5 * BASE + 6) % PRIME)


def test_order_statistics(spark):
    rng = random.Random(4)
    groups = {"even": [float(x) for x in range(1000)], "same": [3.5] * 700, "one": [7.0], "far": [10.0 ** rng.randint(-300, 300) * rng.choice((-1, 1)) for _ in range(400)], "ties": [float(rng.randrange(4)) for _ in range(500)], None: [rng.gauss(0, 1) for _ in range(301)], "two": [-1.5, 2.5]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("even", None), ("even", math.nan), ("same", math.inf), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    shares = {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    found = {r.g: r for r in percentiles(df, ["g"], "x", shares).collect()}
    assert set(found) == set(groups)
    for g, xs in groups.items():
        assert found[g].n == len(xs)
        assert [found[g][k] for k in shares] == [sorted(xs)[max(math.ceil(p * len(xs)), 1) - 1] for p in shares.values()]
    assert {r.g: r["median"] for r in medians(df, ["g"], "x").collect()} == {g: statistics.median(xs) for g, xs in groups.items()}
    whole = sorted(x for xs in groups.values() for x in xs)
    assert medians(df, [], "x").first()["median"] == statistics.median(whole)
    assert order_statistics(df.limit(0), ["g"], "x", {"a": F.lit(1)}).count() == 0


def test_tracked_spans(spark):
    texts = ["mail a.b@c.org, then 10.20.30.40 and name: Bob, http://x.y/z?q=a@b.com end", "no masks at all", "x@y.zz", "", "Contact:  Ann; +1 (499) 555 1234 5678 1234 1234 1234"]
    rows = [(t, a, b) for t in texts for a in range(len(t)) for b in range(a + 1, min(a + 9, len(t)) + 1)]

    def plain(text: str, start: int, end: int) -> tuple:
        for pattern, new in MASKS:
            at = 0
            while m := re.compile(pattern).search(text, at):
                put = m.expand(new.replace("$1", r"\1"))
                by = len(put) - len(m[0])
                start = start + by if start >= m.end() else m.start() if start > m.start() else start
                end = end + by if end >= m.end() else m.start() + len(put) if end > m.start() else end
                text, at = text[: m.start()] + put + text[m.end() :], m.start() + len(put)
        return text, start, end

    df = spark.createDataFrame(rows, "text string, start int, end int").withColumns({"t0": F.col("text"), "s0": F.col("start"), "e0": F.col("end")})
    found = masked_with_span(df, "text", "start", "end").collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.text, r.start, r.end) == plain(r.t0, r.s0, r.e0)
    assert masked_with_span(spark.createDataFrame([(None, 0, 1)], "text string, start int, end int"), "text", "start", "end").count() == 1


def walk(blocks: list) -> list[str]:
    out = []
    for b in blocks:
        kind, table = b["type"], b.get("table", {})
        if kind in ("paragraph", "heading", "list") and (b.get("text") or "").strip():
            out.append(b["text"])
        if kind == "table":
            rows = [[c.strip() for c in row if c and c.strip()] for row in table.get("cells", [])]
            rows = [": ".join(r) if len(r) == 2 else " | ".join(r) for r in rows if r]
            caption = [table["caption"]] if table.get("caption") else []
            out += rows + caption if table.get("captionBelow") else caption + rows
        if b.get("note") and kind not in ("image", "separator"):
            out.append(f"(note: {b['note']})")
        out += walk(b.get("children", []))
    return out


def test_nested_blocks(spark):
    rng = random.Random(6)

    def block(depth: int) -> dict:
        b: dict = {"type": rng.choice(["paragraph", "heading", "list", "table", "image", "separator"])}
        if b["type"] == "table":
            b["table"] = {"cells": [[rng.choice(["a", "bb ", "", None]) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(4))]}
            if rng.random() < 0.6:
                b["table"] |= {"caption": "cap", "captionBelow": rng.random() < 0.5}
        elif rng.random() < 0.8:
            b["text"] = f"text {rng.randrange(99)}"
        if rng.random() < 0.3:
            b["note"] = "a note"
        if depth and rng.random() < 0.6:
            b["children"] = [block(depth - 1) for _ in range(rng.randrange(4))]
        return b

    docs = {i: [block(rng.randrange(9)) for _ in range(rng.randrange(5))] for i in range(40)}
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in docs.items()] + [(99, None)], "id int, b string").select("id", F.parse_json("b").alias("b"))
    found: dict = {}
    for r in block_lines(df, "id", "b").orderBy("id", "line_no").collect():
        assert r.line_no == len(found.setdefault(r.id, []))
        found[r.id].append(r.line)
    assert found == {i: x for i, b in docs.items() if (x := walk(b))}
    with pytest.raises(Exception, match="unknown block"):
        block_lines(spark.sql("""select 1 as id, parse_json('[{"type": "video"}]') as b"""), "id", "b").collect()
