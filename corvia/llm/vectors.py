"""Helpers on vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_finite(vector: Column) -> Column:
    """True of arrays that are not null and hold finite numbers only."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))), F.lit(False))


def floored(vector: Column, scale: int) -> Column:
    """Each component x as the integer floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def integer_kind(ints: DataFrame, vector_col: str) -> tuple[int | None, type]:
    """The most components of a vector (null without rows), and the narrowest integer that holds any squared distance; an error if none does."""
    dims, low, high = ints.agg(F.max(F.size(vector_col)), F.min(F.array_min(vector_col)), F.max(F.array_max(vector_col))).first()
    farthest = ((high or 0) - (low or 0)) ** 2 * (dims or 0)
    if farthest >= 1 << 62:
        raise ValueError("a squared distance would not fit into a long")
    return dims, np.int32 if farthest < 1 << 31 else np.int64


def matrix(column: pa.Array | list, dims: int, dtype: type = np.float64) -> np.ndarray:
    """Rows of an array column as a matrix; shorter vectors end in zeros."""
    if isinstance(column, (pa.Array, pa.ChunkedArray)):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        flat = column.flatten()
        if len(flat) == len(column) * dims and (not len(column) or np.diff(column.offsets.to_numpy()).max() == dims):
            return flat.to_numpy(zero_copy_only=False).reshape(-1, dims).astype(dtype)
        column = column.to_pylist()
    out = np.zeros((len(column), dims), dtype)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out
