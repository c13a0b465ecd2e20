"""Centroid clustering with block-norm screening."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import discard, written
from corvia.llm.vectors import all_finite, floored, integer_kind, matrix

#: Bounds come from rounded norms; they are lowered by this share of the squared lengths before they rule a centroid out.
SLACK = 1e-9


def segment_norms(v: np.ndarray, segments: int) -> np.ndarray:
    """The norm of each of ``segments`` runs of components: what stands for a vector in the screening."""
    return np.stack([np.sqrt((x.astype(np.float64) ** 2).sum(1)) for x in np.array_split(v, segments, axis=1)], 1)


def exact(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v.astype(np.int64) - c
    return (d * d).sum(1)


def screened_nearest(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each row, ties to the smaller number, and how many distances were worked out.

    By Cauchy-Schwarz, a vector and a centroid are at least as far apart as the vectors of their segment
    norms. Centroids are tried in the order of that bound; a row is done once the next bound is above its
    best distance.
    """
    heads = segment_norms(centroids, norms.shape[1])
    bounds = sum((norms[:, s, None] - heads[None, :, s]) ** 2 for s in range(norms.shape[1]))
    bounds -= SLACK * ((norms**2).sum(1)[:, None] + (heads**2).sum(1)[None, :])
    order = bounds.argsort(1, kind="stable")
    near = order[:, 0].copy()
    best = exact(v, centroids[near])
    left, tried = np.arange(len(v)), len(v)
    for step in range(1, len(centroids)):
        c = order[left, step]
        go_on = bounds[left, c] <= best[left]
        left, c = left[go_on], c[go_on]
        if not len(left):
            break
        d = exact(v[left], centroids[c])
        tried += len(left)
        closer = (d < best[left]) | (d == best[left]) & (c < near[left])
        best[left[closer]], near[left[closer]] = d[closer], c[closer]
    return near, best, tried


def cluster_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, segments: int = 8, block_rows: int = 2048) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector of ``dims`` finite components.

    Components become integers floor(scale * x). Centroids start as the ``k`` vectors of smallest
    ``sha256('<seed>:<id>')``; each round assigns all vectors and replaces non-empty centroids by the floor
    of their vectors' mean; then vectors are assigned once more. Vectors are written once, in blocks with
    the norms of their ``segments``; a round is one pass over the blocks, and ``k * dims`` sums reach the
    driver, however many vectors there are.

    Rows without id come last in the order of the hashes and are assigned like others; repeated ids count as
    rows of their own, in the order of their vectors; fewer vectors than ``k`` start fewer centroids; other
    vectors are left out; no rows give none. Components so large that a squared distance exceeds a long
    are an error. Other columns are not read.
    """
    spark = rows.sparkSession
    usable = all_finite(F.col(vector_col)) & (F.size(vector_col) == dims)
    own = rows.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), floored(F.col(vector_col), scale).alias("v"))
    found, kind = integer_kind(own, "v")
    if found is None:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                x = batch.slice(at, block_rows)
                v = matrix(x.column(1), dims, kind)
                yield pa.RecordBatch.from_arrays([pa.array([x.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([v.tobytes()]), pa.array([segment_norms(v, segments).tobytes()])], ["ids", "block", "norms"])

    blocks = written(own.mapInArrow(pack, "ids array<long>, block binary, norms binary"), "blocks")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = own.orderBy(F.asc_nulls_last(hashed), "v").limit(k).select("v").toArrow().column("v")
    centroids = matrix(first, dims, np.int64)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for ids, raw, norms in zip(*(batch.column(i) for i in range(3))):
                v = np.frombuffer(raw.as_py(), kind).reshape(-1, dims)
                yield (ids.values, v, *screened_nearest(v, np.frombuffer(norms.as_py()).reshape(-1, segments), centroids))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, v, near, _, _ in assigned(batches):
            n += np.bincount(near, minlength=len(centroids))
            np.add.at(total, near, v)
        used, place = np.flatnonzero(n), np.arange(dims, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, dims).astype(np.int32)), pa.array(np.tile(place, len(used))), pa.array(np.repeat(n[used], dims)), pa.array(total[used].ravel())], ["cluster", "place", "n", "total"])

    for _ in range(rounds):
        sums = blocks.mapInArrow(totals, "cluster int, place int, n long, total long").groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in sums.collect():  # k * dims rows at most
            centroids[r.cluster, r.place] = r.total // r.n

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, near, best, _ in assigned(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    labelled = written(blocks.mapInArrow(label, "vec_id long, cluster int, distance long"), "labelled")
    discard(blocks)
    inertia = {r.cluster: r.s for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)
    return labelled.select(
        F.col("vec_id").alias(id_col), "cluster", "distance",
        of([inertia.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
    )
