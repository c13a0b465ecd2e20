"""Fixed-window counters and latest-wins state, for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admitted(events: DataFrame, key: str, ts: str, order: str, width: str = "60 seconds", limit: int = 60) -> DataFrame:
    """``events`` and ``allowed``: whether an event is among the first ``limit`` of its key in its fixed window. Rows without time are in a window of their own."""
    rank = F.row_number().over(Window.partitionBy(key, F.window(ts, width)["start"]).orderBy(ts, order))
    return events.where(F.col(ts).isNotNull()).withColumn("allowed", rank <= limit).unionByName(events.where(F.col(ts).isNull()).withColumn("allowed", F.lit(True)))


def window_counts(events: DataFrame, key: str, ts: str, width: str = "60 seconds", late: str = "0 seconds", limit: int = 60) -> DataFrame:
    """``key, start, n, exceeded`` of each window; of a stream, windows close as the watermark passes, and their state goes."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("_w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("_w.start").alias("start"), "n", (F.col("n") > limit).alias("exceeded"))


def latest(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of each key that comes last; of a stream, in update mode, the state holds one row a key."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))
