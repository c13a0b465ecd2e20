"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014) on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import discard, written


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row ``node, component`` for every node of an edge list; ``component`` is the smallest node reachable.

    Each round is two star steps, each an aggregate and a join on the node. The aggregates combine before
    the shuffle and the joins may be split by AQE, so a centre with very many neighbours is no single
    task's work. Edges move between rounds through a written table; only two numbers reach the driver.
    Loops and repeated edges are ignored, null ends drop the edge, no edges give no rows.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    now = written(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    seen = _signature(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        pulled = large.join(low, "b")
        small = pulled.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(pulled.select(F.col("m").alias("a"), "b")).distinct()
        last, now = now, written(small, "edges")
        discard(last)
        before, seen = seen, _signature(now)
        if before == seen:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
    return tuple(row)
