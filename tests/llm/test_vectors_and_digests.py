"""Exact dedup, clustering and vector codes against plain versions, with nulls, ties, repeats, empties and clashing columns."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvia.llm.clusters import cluster_vectors, screened_nearest, segment_norms
from corvia.llm.codes import compress_vectors, nearest_entries
from corvia.llm.exact import CuckooIndex, exact_dedup, live_digests

CLASH = ("id", "row", "digest", "size", "n_chars", "v", "ids", "block", "norms", "cluster", "code", "_l", "_s", "salt", "error", "keep_id", "kept")


def table(spark, rows, columns):
    df = spark.createDataFrame(rows, columns)
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns})


# --- exact dedup


@pytest.mark.parametrize("tag_bits", [2, 16])
def test_index_against_a_dict(tag_bits):
    """Few tags make most hits false ones; the smallest table overflows at once."""
    rng = random.Random(tag_bits)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    index, model = CuckooIndex(buckets=1, tag_bits=tag_bits), {}
    for step in range(12000):
        key = rng.choice(keys[: 1 + step // 3])
        if rng.random() < 0.3:
            assert index.delete(key) == (model.pop(key, None) is not None)
        elif key not in model:
            assert index.find(key) < 0
            model[key] = (step,)
            index.put(key, (step,))
        if step % 997 == 0:
            assert dict(index.entries()) == model and index.live == len(model)
    assert all(index.values[index.find(k)] == v for k, v in model.items())
    assert all(index.find(k) < 0 for k in keys if k not in model)


def plain(text: str | None) -> str:
    return (text or "").translate({c: None for c in (0x20, *range(0x09, 0x0E))})


def test_exact_dedup(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "ab"), (4, None), (5, ""), (6, " \t\r\n\v\f"), (7, "a b"), (8, "\U0001f600 é"), (9, "\U0001f600é"), (2, "a  b"), (2, "other"), (None, "a\tb\n"), (None, None), (10, "x" * 400_000), (11, "x " * 200_000)]
    rows += [(100 + i, "a hot text" + " " * (i % 7)) for i in range(3000)] + [(9000, "straße"), (9001, "strasse")]
    found = exact_dedup(table(spark, rows, "doc_id long, text string").repartition(5), shard_rows=50).collect()
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i or 0))
    want = Counter((i, (lambda k: None if k[1] else k[2])(min(groups[plain(t)])), len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == want
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact_dedup(table(spark, [], "doc_id long, text string")).count() == 0


def test_live_digests(spark):
    def after(stored, rows):
        out = live_digests(stored, spark.createDataFrame(rows, "text string, change int"), shard_rows=3)
        return spark.createDataFrame(out.collect(), "digest binary, live long")

    name = {hashlib.sha256(plain(t).encode()).digest(): t for t in ("a", "b", "c", "d", "")}
    one = after(None, [("a", 1), ("a ", 1), ("b", 1), ("c", 1), (None, 1), ("d", -1), ("c", None)])
    assert {name[bytes(r.digest)]: r.live for r in one.collect()} == {"a": 2, "b": 1, "c": 1, "": 1}
    two = after(one, [("a", -1), ("b", -1), ("b", 1), ("c", -1), ("d", 1), ("c", -1)])
    assert {name[bytes(r.digest)]: r.live for r in two.collect()} == {"a": 1, "b": 1, "": 1, "d": 1}
    assert live_digests(two, spark.createDataFrame([("a", -1), ("b", -1), ("d", -1), ("", -1)], "text string, change int")).count() == 0


# --- vectors


def vectors(dims: int, n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dims)) / 4
    rows = [(i * 3 - 30, (centres[i % 5] + rng.standard_normal(dims) / 40).tolist(), i % 3) for i in range(n)]
    bad = [(2001, None, 1), (2002, [1.0] * (dims - 1) + [None], 1), (2003, [float("nan")] * dims, 1), (2004, [float("inf")] + [0.0] * (dims - 1), None)]
    return rows + bad + [(2005, rows[0][1], None), (2006, rows[0][1], None), (rows[1][0], rows[2][1], 2), (None, rows[3][1], 0), (2007, [0.0] * dims, 0)]


def good(v) -> bool:
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def ordered(rows, key):
    return [x for *_, x in sorted((key(i) is None, key(i) or "" if isinstance(key(i), str) else key(i) or 0, v.tolist(), v) for i, v, *_ in rows)]


def plain_clusters(rows, dims, scale, k, rounds, seed=1) -> list[tuple]:
    own = [(i, np.floor(scale * np.array(v)).astype(np.int64)) for i, v, _ in rows if good(v) and len(v) == dims]
    centres = ordered(own, lambda i: None if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]
    assign = lambda: [min((int(((v - c) ** 2).sum()), n) for n, c in enumerate(centres)) for _, v in own]
    for _ in range(rounds):
        near = assign()
        for n in range(len(centres)):
            held = [v for (_, v), (_, m) in zip(own, near) if m == n]
            if held:
                centres[n] = sum(held) // len(held)
    near = assign()
    total, by = sum(d for d, _ in near), Counter()
    for d, n in near:
        by[n] += d
    return [(i, n, d, by[n], total, hashlib.sha256(",".join(map(str, centres[n].tolist())).encode()).hexdigest()) for (i, _), (d, n) in zip(own, near)]


def test_clusters(spark):
    rows = vectors(12, 150, 3) + [(3000, [0.5] * 11, 1), (3001, [0.5] * 13, 1), (3002, [], 1)]
    df = table(spark, rows, "vec_id long, embedding array<double>, label int")
    for k, segments, block in ((7, 4, 16), (300, 5, 64)):
        found = cluster_vectors(df.repartition(3), dims=12, k=k, segments=segments, block_rows=block)
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain_clusters(rows, 12, 64, k, 3)))
    assert cluster_vectors(df.limit(0)).count() == 0
    assert cluster_vectors(df, dims=99).count() == 0
    with pytest.raises(ValueError):
        cluster_vectors(spark.createDataFrame([(1, [1e30] * 4), (2, [-1e30] * 4)], "vec_id long, embedding array<double>"), dims=4)


def test_screening_spares_distances_and_changes_none():
    rng = np.random.default_rng(4)
    centres = rng.integers(-60, 60, (16, 64)) * rng.integers(0, 2, (16, 8)).repeat(8, 1)
    v = (centres[rng.integers(0, 16, 3000)] + rng.integers(-6, 7, (3000, 64))).astype(np.int32)
    near, best, tried = screened_nearest(v, segment_norms(v, 8), centres)
    all_of_them = ((v[:, None, :].astype(np.int64) - centres[None]) ** 2).sum(2)
    assert (near == all_of_them.argmin(1)).all() and (best == all_of_them.min(1)).all()
    assert tried < 0.25 * all_of_them.size
    same = np.tile(v[:1], (5, 1)).astype(np.int64)  # ties at distance zero and beyond go to the smaller number
    assert screened_nearest(v[:1], segment_norms(v[:1], 8), same)[0].tolist() == [0]


def plain_codes(rows, scale, parts, entries, rounds) -> list[tuple]:
    own = [(i, np.floor(scale * np.array(v, float)).astype(np.int64), label) for i, v, label in rows if good(v)]
    width = -(-max(len(v) for _, v, _ in own) // parts)
    own = [(i, np.pad(v, (0, width * parts - len(v))), label) for i, v, label in own]
    first = ordered(own, lambda i: i)[:entries]
    books = [[x[p * width : (p + 1) * width] for x in first] for p in range(parts)]
    assign = lambda: [[min((int(((v[p * width : (p + 1) * width] - e) ** 2).sum()), n) for n, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in own]
    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for n in range(len(books[p])):
                held = [v[p * width : (p + 1) * width] for (_, v, _), x in zip(own, near) if x[p][1] == n]
                if held:
                    books[p][n] = sum(held) // len(held)
    near, by = assign(), Counter()
    for (_, _, label), x in zip(own, near):
        by[label] += sum(d for d, _ in x)
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e.tolist()).encode()).hexdigest()
    return [(i, "".join(f"{n:02x}" for _, n in x), sum(d for d, _ in x), by[label], digest) for (i, _, label), x in zip(own, near)]


def test_codes(spark):
    rows = vectors(12, 90, 5) + [(3000, [0.25] * 5, 1), (3001, [], None)]
    df = table(spark, rows, "vec_id long, embedding array<double>, label int")
    for parts, entries, block in ((4, 20, 16), (5, 256, 64)):
        found = compress_vectors(df.repartition(3), parts=parts, entries=entries, rounds=3, block_rows=block)
        assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain_codes(rows, 1024, parts, entries, 3)))
    assert compress_vectors(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        compress_vectors(spark.createDataFrame([(1, [1e30], 1), (2, [-1e30], 1)], "vec_id long, embedding array<double>, label int"))


def test_nearest_entries_of_either_width():
    rng = np.random.default_rng(6)
    block, books = rng.integers(-900, 900, (8, 50)), rng.integers(-900, 900, (8, 30))
    narrow, wide = nearest_entries(block.astype(np.int32), books, 2), nearest_entries(block, books, 2)
    assert all((a == b).all() for a, b in zip(narrow, wide))
    d = ((block[:4, :, None] - books[:4, None, :]) ** 2).sum(0)
    assert (wide[0][0] == d.argmin(1)).all() and (wide[1][0] == d.min(1)).all()
