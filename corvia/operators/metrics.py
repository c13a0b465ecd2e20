"""Metrics over results: rates, agreement, drift, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(n: Column, total: Column) -> Column:
    """A share rounded to 6 places, null of nothing."""
    return F.round(F.try_divide(n.cast("double"), total.cast("double")), 6)


def activation_rates(ids: DataFrame, hits: DataFrame, id_col: str, doc_col: str, docs: DataFrame) -> DataFrame:
    """``id, records, rate`` of every id of the catalog, those never observed too, over the number of ``docs``."""
    seen = hits.groupBy(id_col).agg(F.countDistinct(doc_col).alias("records"))
    total = F.broadcast(docs.agg(F.count(F.lit(1)).alias("_n")))  # one row
    every = ids.select(id_col).join(seen, id_col, "left").join(total, how="left")
    return every.select(id_col, F.coalesce("records", F.lit(0)).alias("records"), "_n").select(id_col, "records", rate(F.col("records"), F.col("_n")).alias("rate"))


def confusion(predicted: DataFrame, expected: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``tp, fp, fn, precision, recall`` by group, from one full outer join of keyed rows."""
    both = predicted.select(*keys, F.lit(True).alias("_p")).join(expected.select(*keys, F.lit(True).alias("_e")), keys, "full_outer")
    counted = both.groupBy(*by).agg(F.count_if(F.col("_p") & F.col("_e")).alias("tp"), F.count_if(F.col("_p") & F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_p").isNull() & F.col("_e")).alias("fn"))
    return counted.withColumns({"precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": rate(F.col("tp"), F.col("tp") + F.col("fn"))})


def kappa(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """``n, agreed, kappa`` of two raters, in whole numbers until the one division: (agreed * n - S) / (n * n - S); null if all labels are one."""
    cells = pairs.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("c"))
    sides = cells.groupBy(*by, a).agg(F.sum("c").alias("na")).withColumnRenamed(a, "_l").join(cells.groupBy(*by, b).agg(F.sum("c").alias("nb")).withColumnRenamed(b, "_l"), [*by, "_l"])
    chance = sides.groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("s")) if by else sides.agg(F.sum(F.col("na") * F.col("nb")).alias("s"))
    totals = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("agreed"))
    joined = totals.join(chance, by, "left") if by else totals.crossJoin(F.broadcast(chance))  # one row each
    s = F.coalesce("s", F.lit(0))
    return joined.select(*by, "n", "agreed", F.round(F.try_divide((F.col("agreed") * F.col("n") - s).cast("double"), (F.col("n") * F.col("n") - s).cast("double")), 6).alias("kappa"))


def drift(current: DataFrame, baseline: DataFrame, key: str, threshold: float) -> DataFrame:
    """``key, now, then, delta, state`` of two tables of rates (``rate``); ids of one side alone count as 0 on the other."""
    return drifted(current.select(key, F.col("rate").alias("now")).join(baseline.select(key, F.col("rate").alias("then")), key, "full_outer"), key, threshold)


def drifted(both: DataFrame, key: str, threshold: float) -> DataFrame:
    """The same of one table with both rates (``now, then``)."""
    now, then = F.coalesce("now", F.lit(0.0)), F.coalesce("then", F.lit(0.0))
    delta = F.round(now - then, 6)
    state = F.when((then == 0) & (now > 0), "appeared").when((then > 0) & (now == 0), "vanished").when(F.abs(delta) >= threshold, "alert").otherwise("ok")
    return both.select(key, now.alias("now"), then.alias("then"), delta.alias("delta"), state.alias("state"))


def field_changes(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``keys, field, before, after`` of every field that differs, null-safe; rows of one side alone give all their fields."""
    long = lambda df: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(*keys, "x.*")
    both = long(old).withColumnRenamed("value", "before").join(long(new).withColumnRenamed("value", "after"), [*keys, "field"], "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table alone, with ``side`` (left, right), repeats counted."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
