"""Corpus operators: identity, dedup, quotas, deterministic splits and samples, digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order: `WindowGroupLimit` keeps one row a key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def two_stage_dedup(df: DataFrame, url: str, text_hash: str, order: str) -> DataFrame:
    """By URL first, then by content hash; rows without URL pass the first stage."""
    by_url = keep_first(df.where(F.col(url).isNotNull()), [url], [order]).unionByName(df.where(F.col(url).isNull()))
    return keep_first(by_url, [text_hash], [order])


def exclude_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_anti")


def quota(df: DataFrame, by: str, order: list[Column | str], limit: int) -> DataFrame:
    """The first few rows of each group: `WindowGroupLimit` keeps ``limit`` rows a group and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def own_quota(df: DataFrame, by: str, order: str, limit: Column) -> DataFrame:
    """The first rows of each group by a unique number, as many as the row's own limit says."""
    return ranked(df, by, F.col(order), value_bucket(df, order)).where(F.col("_rank") <= limit).drop("_rank")


def hash_order(key: Column) -> Column:
    """A stable pseudo-random order."""
    return F.sha2(key.cast("string"), 256)


def ranked(df: DataFrame, by: str, order: Column, bucket: Column, rank: str = "_rank") -> DataFrame:
    """``df`` and its rank by ``order`` (unique) within ``by``, with no stratum in one task.

    ``bucket`` must not fall as ``order`` rises. Rows are ranked within (stratum, bucket); the rows of the
    stratum's buckets before, from an aggregate of a row a bucket, are added. Null is a stratum, too.
    """
    own = df.withColumns({"_by": F.struct(by), "_bucket": bucket})
    sizes = own.groupBy("_by", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_by", "_bucket", (F.sum("_n").over(Window.partitionBy("_by").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    within = own.withColumn(rank, F.row_number().over(Window.partitionBy("_by", "_bucket").orderBy(order)))
    return within.join(before, ["_by", "_bucket"]).withColumn(rank, F.col(rank) + F.col("_before")).drop("_by", "_bucket", "_before")


def hash_bucket(key: Column) -> Column:
    """The first 8 bits of the order of :func:`hash_order`."""
    return F.substring(hash_order(key), 1, 2)


def value_bucket(df: DataFrame, column: str, buckets: int = 256) -> Column:
    """Equal ranges between the smallest and the largest value; two numbers reach the plan as scalar subqueries."""
    low, high = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    return F.coalesce(F.floor((F.col(column) - low) / F.greatest((high - low) / buckets, F.lit(1e-9))), F.lit(0))


def allocate(share: dict, low: dict, high: dict, want: int) -> dict:
    """Whole numbers near the shares within their bounds that sum to ``want``: rounded down first, what is left over by the largest remainders, in as many sorts as the bounds take."""
    out = {k: min(max(int(v), low[k]), high[k]) for k, v in share.items()}
    while missing := want - sum(out.values()):
        step = 1 if missing > 0 else -1
        order = sorted((k for k in out if (out[k] < high[k] if step > 0 else out[k] > low[k])), key=lambda k: ((out[k] - share[k]) * step, str(k)))
        out |= {k: out[k] + step for k in order[: abs(missing)]}
    return out


def split_quotas(counts: dict, ratio: float) -> dict:
    """Held-out rows per stratum: at least 1 and at most all but 1 of a stratum of two or more; the total is the rounded share of all, as far as the bounds allow."""
    low, high = {k: int(n > 1) for k, n in counts.items()}, {k: max(n - 1, 0) for k, n in counts.items()}
    want = min(max(round(sum(counts.values()) * ratio), sum(low.values())), sum(high.values()))
    return allocate({k: n * ratio for k, n in counts.items()}, low, high, want)


def sample_quotas(counts: dict, size: int) -> dict:
    """Rows per stratum of a proportional sample, at least 1 each if the size allows."""
    total = sum(counts.values())
    size = min(size, total)
    return allocate({k: size * n / total for k, n in counts.items()}, {k: int(size >= len(counts)) for k in counts}, dict(counts), size)


def with_quota(df: DataFrame, strata: str, key: str, quotas: Callable[[dict], dict]) -> DataFrame:
    """``df``, ``_rank`` in hash order and ``_quota``; only the strata's counts, a row a stratum, reach the driver."""
    counts = {r[0]: r["n"] for r in df.groupBy(strata).agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = T.StructType([T.StructField("_of", df.schema[strata].dataType), T.StructField("_quota", T.LongType())])
    table = df.sparkSession.createDataFrame(list(quotas(counts).items()), kinds)
    order = F.struct(hash_order(F.col(key)), F.col(key))
    return ranked(df, strata, order, hash_bucket(F.col(key))).join(F.broadcast(table), F.col(strata).eqNullSafe(F.col("_of"))).drop("_of")


def stratified_split(df: DataFrame, strata: str, key: str, ratio: float = 0.3) -> DataFrame:
    """``df`` and ``split``: an exact, deterministic holdout; a null stratum is one like any other."""
    found = with_quota(df, strata, key, lambda counts: split_quotas(counts, ratio))
    return found.withColumn("split", F.when(F.col("_rank") <= F.col("_quota"), "holdout").otherwise("train")).drop("_rank", "_quota")


def stratified_sample(df: DataFrame, strata: str, key: str, size: int) -> DataFrame:
    """A proportional sample of ``size`` rows, the first of each stratum in hash order."""
    return with_quota(df, strata, key, lambda counts: sample_quotas(counts, size)).where("_rank <= _quota").drop("_rank", "_quota")


def balanced_quota(df: DataFrame, kind: str, first: str, order: str, total: int) -> DataFrame:
    """``total`` rows, half of kind ``first`` (the larger half if odd) and half of the others."""
    own = df.withColumn("_first", F.coalesce(F.col(kind) == first, F.lit(False)))
    limit = F.when(F.col("_first"), (total + 1) // 2).otherwise(total // 2)
    return ranked(own, "_first", F.col(order), value_bucket(df, order)).where(F.col("_rank") <= limit).drop("_first", "_rank")


def digest(df: DataFrame, row: Column) -> DataFrame:
    """``n, digest`` of a dataset whatever its order: the row hashes summed as numbers, so that no task holds them all."""
    part = lambda i: F.conv(F.substring(F.md5(row), i, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("string") for i in (1, 9, 17, 25)]).alias("digest"))


def batches(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """``by, batch, ids``: rows of each group in batches of ``size``, ``order`` a unique number."""
    found = ranked(df, by, F.col(order), value_bucket(df, order)).withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("int"))
    return found.groupBy(by, "batch").agg(F.array_sort(F.collect_list(order)).alias("ids"))
