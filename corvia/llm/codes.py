"""Vector code compression: codebooks of vector parts, learned by tree aggregation over columnar blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import discard, written
from corvia.llm.vectors import all_finite, floored, integer_kind, matrix

#: A label's total goes to so many salts, so that a label that holds a third of all rows is no single task's.
SALTS = 16


def nearest_entries(block: np.ndarray, books: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part's nearest entry, ties to the lower index.

    ``block`` has a row a dimension and a column a vector, ``books`` a row a dimension and a column an
    entry. Distances to all entries accumulate dimension by dimension, in integers.
    """
    width, n, entries = len(block) // parts, block.shape[1], books.shape[1]
    books = books.astype(block.dtype)
    codes, errors = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64)
    total, step = np.empty((n, entries), block.dtype), np.empty((n, entries), block.dtype)
    for part in range(parts):
        total[:] = 0
        for d in range(part * width, (part + 1) * width):
            np.subtract.outer(block[d], books[d], out=step)
            np.multiply(step, step, out=step)
            np.add(total, step, out=total)
        codes[part] = total.argmin(1)
        errors[part] = total[np.arange(n), codes[part]]
    return codes, errors


Tensors = tuple[np.ndarray, np.ndarray]


def merged(a: Tensors, b: Tensors) -> Tensors:
    return a[0] + b[0], a[1] + b[1]


def compress_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4, block_rows: int = 512
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each vector that holds finite components only.

    Components become integers floor(scale * x); a vector is cut into ``parts`` equal parts, each coded as
    the index of the nearest of its position's ``entries`` (at most 256) as two hex digits. A codebook starts as the parts of
    the smallest ids; each round assigns all parts and replaces the used entries by the floor of their
    parts' mean. Vectors are written once as blocks of ``block_rows``, a row of integers a dimension; a round
    is one ``treeAggregate`` over the blocks, whose sum and count tensors merge through a tree and whose
    size depends on the codebooks alone.

    Shorter vectors end in zeros, as do all if the longest cannot be cut evenly; rows without id come last
    in the order and are coded like others; repeated ids count as rows of their own, in the order of their
    vectors; fewer rows than entries start shorter codebooks; null labels are one label; no rows give none.
    Components so large that a squared distance exceeds a long are an error. Other columns are not read.
    """
    spark = rows.sparkSession
    own = rows.where(all_finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), floored(F.col(vector_col), scale).alias("v"))
    longest, kind = integer_kind(own, "v")
    if longest is None:
        return spark.createDataFrame([], f"{id_col} long, code string, error long, label_error long, codebooks_sha256 string")
    width = -(-longest // parts)
    dims = width * parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                x = batch.slice(at, block_rows)
                block = np.ascontiguousarray(matrix(x.column(2), dims, kind).T)
                yield pa.RecordBatch.from_arrays([pa.array([x.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.column(1).to_pylist()], pa.list_(pa.string())), pa.array([block.tobytes()], pa.binary())], ["ids", "labels", "block"])

    blocks = written(own.mapInArrow(pack, "ids array<long>, labels array<string>, block binary"), "blocks")
    first = own.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).toArrow().column("v")
    books = np.ascontiguousarray(matrix(first, dims, np.int64).T)

    def gather(into: Tensors, row: tuple) -> Tensors:
        block = np.frombuffer(row[0], kind).reshape(dims, -1)
        codes, _ = nearest_entries(block, books, parts)
        for part in range(parts):
            np.add.at(into[0][part], codes[part], block[part * width : (part + 1) * width].T)
            np.add.at(into[1][part], codes[part], 1)
        return into

    for _ in range(rounds):
        nothing = (np.zeros((parts, books.shape[1], width), np.int64), np.zeros((parts, books.shape[1]), np.int64))
        sums, counts = blocks.select("block").rdd.treeAggregate(nothing, gather, merged)
        for part in range(parts):
            used = np.flatnonzero(counts[part])
            books[part * width : (part + 1) * width, used] = (sums[part][used] // counts[part][used, None]).T

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, raw in zip(*(batch.column(i) for i in range(3))):
                codes, errors = nearest_entries(np.frombuffer(raw.as_py(), kind).reshape(dims, -1), books, parts)
                hexes = [bytes(x).hex() for x in codes.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(hexes, pa.string()), pa.array(errors.sum(0))], ["vec_id", "label", "code", "error"])

    coded = written(blocks.mapInArrow(code, "vec_id long, label string, code string, error long"), "coded")
    discard(blocks)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("_l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(totals, F.col("label").eqNullSafe(F.col("_l")) & (F.col("salt") == F.col("_s")))
    flat = [books[part * width : (part + 1) * width].T.ravel() for part in range(parts)]
    digest = hashlib.sha256(",".join(map(str, np.concatenate(flat).tolist())).encode()).hexdigest()
    return joined.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
