"""Exact top-k search by inner product with a pivot-distance index (iDistance; Jagadish et al., 2005)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvia.llm.common import written
from corvia.llm.vectors import all_finite, floored, matrix

#: A bound is widened by this share of the largest norm before it stops a search: distances near zero, computed from inner products, may be off by some 1e-8 of it.
SLACK = 1e-6


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, v``: each component x as floor(scale * x), x as double; vectors that are null or hold null or non-finite components are left out."""
    usable = rows.where(all_finite(F.col(vector_col)) & F.col(id_col).isNotNull())
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), floored(F.col(vector_col), scale).alias("v"))


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more coordinate that takes them all to the norm ``sqrt(top)``: inner products then order as distances do."""
    return np.column_stack([v, np.sqrt(np.maximum(top - (v * v).sum(1), 0.0))])


def pick_pivots(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of a few k-means rounds over the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        near = distances(sample, centres).argmin(1)
        centres = np.stack([sample[near == k].mean(0) if (near == k).any() else c for k, c in enumerate(centres)])
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; through floating point only where that is exact."""
    largest = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1)
    if float(largest) * q.shape[1] < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


LOWEST = np.iinfo(np.int64).min


def search_cell(ids: np.ndarray, v: np.ndarray, dist: np.ndarray, qid: np.ndarray, q: np.ndarray, qdist: np.ndarray, qnorm: np.ndarray, floor: np.ndarray, top: float, k: int, ring: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's best ``k`` in one cell as ``(query, vector, score)``; ``floor`` is a score that ``k`` vectors are known to reach.

    The cell's vectors lie in rings sorted by their distance to the pivot. A query starts at the ring of its
    own distance and goes on to the rings further in and out, and stops where the triangle inequality shows
    that no vector of a ring comes within the distance of its current k-th best.
    """
    order = np.lexsort((ids, dist))
    ids, v, dist = ids[order], v[order], dist[order]
    starts = np.arange(0, len(ids), ring)
    inner, outer = dist[starts], dist[np.minimum(starts + ring, len(ids)) - 1]
    home = np.clip(np.searchsorted(inner, qdist, side="right") - 1, 0, len(starts) - 1)
    best = np.full((len(qid), k), LOWEST)
    found: list[tuple] = []
    for step in range(len(starts)):
        for s in range(len(starts)):
            at = np.flatnonzero(np.abs(home - s) == step)
            if not len(at):
                continue
            least = np.maximum(best[at, 0], floor[at])
            reach = np.where(least == LOWEST, np.inf, np.sqrt(np.maximum(qnorm[at] + top - 2.0 * least, 0.0)))
            gap = np.maximum(np.maximum(inner[s] - qdist[at], qdist[at] - outer[s]), 0.0)
            close = gap <= reach + SLACK * (1 + np.sqrt(top) + np.sqrt(qnorm[at]))
            at, least = at[close], least[close]
            if not len(at):
                continue
            span = slice(starts[s], starts[s] + ring)
            scores = products(q[at], v[span])
            scores[qid[at][:, None] == ids[span][None, :]] = LOWEST
            r, c = np.nonzero(scores >= np.maximum(least, LOWEST + 1)[:, None])
            found.append((at[r], ids[span][c], scores[r, c]))
            best[at] = np.sort(np.partition(np.concatenate([best[at], scores], 1), -k, axis=1)[:, -k:], axis=1)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    row, vec, score = (np.concatenate(x) for x in zip(*found))
    keep = score >= np.maximum(best[row, 0], floor[row])
    row, vec, score = row[keep], vec[keep], score[keep]
    order = np.lexsort((vec, -score, row))
    row, vec, score = row[order], vec[order], score[order]
    first = np.concatenate(([True], row[1:] != row[:-1]))
    nth = np.arange(len(row)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return qid[row[nth < k]], vec[nth < k], score[nth < k]


def top_k(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, pivots: int = 64, sample_rows: int = 8192, cell_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the ``k`` rows of ``rows`` of highest integer inner product, but its own.

    Exact; ties go to the smaller id, fewer than ``k`` candidates give fewer rows. The pivots come from a
    sample of ``sample_rows`` rows (the smallest hashes of their id), every row is indexed: keyed by its
    nearest pivot and its distance to that. A first round searches one cell near each query and so bounds
    its k-th best; the second goes to those cells alone that the triangle inequality leaves, and a cell is
    copied for the blocks of queries that reach it. A pivot with more than ``cell_rows`` rows, as one at which a third of the rows are copies, is dealt over several
    cells; queries come in blocks of ``query_rows``. Vectors that are null or hold null or non-finite
    components and rows without id take no part; shorter vectors end in zeros; rows that repeat count as
    often as they stand there, but for the query's own id; an empty table gives no rows; other columns are
    not read.
    """
    spark = rows.sparkSession
    ints = written(integer_vectors(rows, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "ints")
    asked = integer_vectors(queries, id_col, vector_col, scale).distinct()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    top, dims, n_asked = ints.agg(F.max(norm), F.max(F.size("v"))).first()[:2] + (asked.count(),)
    if top is None or not n_asked:
        return empty
    dims = max(dims, asked.agg(F.max(F.size("v"))).first()[0])
    sample = ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
    centres = pick_pivots(lifted(matrix(sample.column("v"), dims), top), pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(lifted(matrix(batch.column(1), dims), top), centres)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "v", "row", "pivot", "dist"])

    index = written(ints.mapInArrow(key, "vec_id long, v array<long>, row long, pivot int, dist double"), "index")
    known = {r.pivot: r for r in index.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("inner"), F.max("dist").alias("outer")).collect()}  # a row a pivot
    have = np.array(sorted(known))
    cells = np.array([-(-known[p].n // cell_rows) for p in have])
    inner, outer = np.array([known[p].inner for p in have]), np.array([known[p].outer for p in have])
    blocks = -(-n_asked // query_rows)
    of_pivot = F.element_at(F.array(*[F.lit(int(-(-known[p].n // cell_rows)) if p in known else 1) for p in range(len(centres))]), F.col("pivot") + 1)
    dealt = index.withColumn("cell", F.pmod(F.xxhash64("vec_id", "row"), of_pivot).cast("int")).drop("row")

    def route(bounded: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = matrix(batch.column(1), dims)
                qnorm = (q * q).sum(1)
                d = distances(np.column_stack([q, np.zeros(len(q))]), centres[have])
                qid = batch.column(0).to_numpy()
                first = np.stack([d.argmin(1), qid % cells[d.argmin(1)]], 1)
                if not bounded:
                    row, at, cell, floor = np.arange(len(q)), first[:, 0], first[:, 1], np.full(len(q), LOWEST)
                else:
                    least = batch.column(2).to_numpy()
                    reach = np.where(least == LOWEST, np.inf, np.sqrt(np.maximum(qnorm + top - 2.0 * least, 0.0)))[:, None]
                    gap = np.maximum(np.maximum(inner[None, :] - d, d - outer[None, :]), 0.0)
                    row, at = np.nonzero(gap <= reach + SLACK * (1 + np.sqrt(top) + np.sqrt(qnorm))[:, None])
                    n = cells[at]
                    cell = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row, at = np.repeat(row, n), np.repeat(at, n)
                    new = (at != first[row, 0]) | (cell != first[row, 1])
                    row, at, cell = row[new], at[new], cell[new]
                    floor = least[row]
                for i in range(0, len(row), 8192):
                    j = slice(i, i + 8192)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[row[j]]), batch.column(1).take(pa.array(row[j])), pa.array(have[at[j]].astype(np.int32)), pa.array(cell[j].astype(np.int32)), pa.array(d[row[j], at[j]]), pa.array(floor[j])], ["query_id", "q", "pivot", "cell", "qdist", "floor"])

        return run

    def search(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, v = matrix(list(y.q), dims, np.int64), matrix(list(x.v), dims, np.int64)
        qnorm = (q.astype(float) ** 2).sum(1)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), search_cell(x.vec_id.to_numpy(), v, x.dist.to_numpy(), y.query_id.to_numpy(), q, y.qdist.to_numpy(), qnorm, y.floor.to_numpy(), top, k))))

    def searched(routed: DataFrame) -> DataFrame:
        routed = written(routed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "routed")
        keys = ["pivot", "cell", "block"]
        reached = written(routed.select(*keys).distinct(), "reached")  # a cell is copied for those blocks alone that have queries for it
        return dealt.join(reached, ["pivot", "cell"]).groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")

    routed_schema = "query_id long, q array<long>, pivot int, cell int, qdist double, floor long"
    near = written(searched(asked.mapInArrow(route(False), routed_schema)), "near")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("n", F.row_number().over(by_query)).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    bounded = asked.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("floor", F.lit(LOWEST)).alias("floor"))
    found = near.unionByName(searched(bounded.mapInArrow(route(True), routed_schema)))
    return found.withColumn("rank", F.row_number().over(by_query).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
