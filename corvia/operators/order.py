"""Results that depend on the order of rows, without an ordered whole in any task: digests and order statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A row's hash is a digit to this base; digests are numbers modulo the prime.
PRIME, BASE = (1 << 61) - 1, 1_000_003


def joined(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """``(rows, digest)`` of two runs of rows, one after the other. Associative, with ``(0, 0)`` as nothing."""
    return a[0] + b[0], (a[1] * pow(BASE, b[0], PRIME) + b[1]) % PRIME


def ordered_digest(df: DataFrame, order: list[str], content: Column) -> DataFrame:
    """``n, digest`` of the rows in their order: one swapped pair changes it, the partitioning does not.

    Rows go to ranges of ``order``, each range is digested by itself, and the ranges' digests, a row each,
    are joined in order. Rows that tie in ``order`` are taken by their content. A null content counts as a
    row of its own kind.
    """
    hashed = F.conv(F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), content.cast("string")), F.lit("")), 256), 1, 15), 16, 10).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = digest = 0
        part = None
        for batch in batches:
            for h, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, digest = n + 1, (digest * BASE + h) % PRIME
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([digest], pa.int64())], ["part", "n", "digest"])

    @F.pandas_udf("struct<n:long,digest:long>")
    def fold(runs: pd.Series) -> pd.DataFrame:
        out = []
        for run in runs:
            total = (0, 0)
            for r in sorted(run, key=lambda r: r["part"]):
                total = joined(total, (int(r["n"]), int(r["digest"])))
            out.append({"n": total[0], "digest": total[1]})
        return pd.DataFrame(out, columns=["n", "digest"])

    rows = df.select(*order, hashed.alias("_h")).repartitionByRange(*order, "_h").sortWithinPartitions(*order, "_h")
    runs = rows.select("_h", F.spark_partition_id().alias("part")).mapInArrow(run, "part int, n long, digest long")
    return runs.agg(F.collect_list(F.struct("part", "n", "digest")).alias("runs")).select(fold("runs").alias("d")).select("d.*")


#: Bins of a histogram and histograms one within the other: a group's range is cut into BINS ** LEVELS parts.
BINS, LEVELS, SALTS = 1024, 3, 16


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """``by`` and a column a name of ``ranks``: the value of that rank (from 1, made of the group's ``n``) among the finite values of each group, as a double; ``n`` too.

    Equal values count once, with their number. A histogram over a group's range shows in which bin a rank
    lies, the next one cuts up that bin alone, and only what shares the last, least bin is sorted. So no task
    holds the values of a group; its rows are salted where they meet its ranges. Groups may be null, and
    groups without finite values have no row.
    """
    v = F.col(value).cast("double")
    finite = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    keys = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counts = finite.groupBy(keys.alias("k"), v.alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    whole = counts.groupBy("k").agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    named = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    wanted = whole.select("k", "n", "low", "high", F.lit(0).cast("long").alias("before"), F.explode(named).alias("w")).select("k", "n", "low", "high", "before", "w.*")

    def met(wanted: DataFrame) -> DataFrame:
        """The counts within the range of a wanted rank."""
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return counts.alias("x").join(salted.alias("w"), F.expr("x.k <=> w.k and x.salt = w.salt and x.v between w.low and w.high")).select("w.k", "w.name", "w.rank", "w.n", "w.before", "w.low", "w.high", "x.v", "x.c")

    per = ["k", "name"]
    for _ in range(LEVELS):
        width = F.col("high") / BINS - F.col("low") / BINS
        place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(BINS - 1))).otherwise(F.lit(0).cast("long"))
        bins = met(wanted).groupBy(*per, "rank", "n", "before", place.alias("bin")).agg(F.sum("c").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        up_to = F.col("before") + F.sum("c").over(Window.partitionBy(*per).orderBy("bin"))
        hit = bins.withColumn("up_to", up_to).where("up_to >= rank and up_to - c < rank")
        wanted = hit.select("k", "n", "low", "high", (F.col("up_to") - F.col("c")).alias("before"), "name", "rank")
    up_to = F.col("before") + F.sum("c").over(Window.partitionBy(*per).orderBy("v"))
    found = met(wanted).withColumn("up_to", up_to).where("up_to >= rank and up_to - c < rank")
    out = found.groupBy("k").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return out.select(*[F.col("k")[c].alias(c) for c in by], "n", *ranks)


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by, n`` and the nearest-rank percentiles of each group."""
    return order_statistics(df, by, value, {name: F.greatest(F.ceil(F.col("n") * p), F.lit(1)) for name, p in shares.items()})


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by, n, median``: the middle value of each group, or the mean of the two."""
    found = order_statistics(df, by, value, {"_low": F.floor((F.col("n") + 1) / 2), "_high": F.floor(F.col("n") / 2) + 1})
    return found.select(*by, "n", ((F.col("_low") + F.col("_high")) / 2).alias("median"))
