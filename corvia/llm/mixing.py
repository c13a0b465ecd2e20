"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import written

#: Of one draw, repetitions are looked for up to this many: beyond it lies less than 1e-15 of a Poisson distribution of any mean up to the highest of a draw.
MOST, HIGHEST_MEAN = 64, 16.0


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by ``:``, 52 bits of it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k whose Poisson distribution function reaches above ``u``."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("k"), u.alias("u"), mean.alias("mean"))  # the lambda reads no outer column: one it reads is lost when filters are moved

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * s["mean"] / i
        return F.struct(p.alias("p"), (s["below"] + p).alias("below"), F.when(s["u"] >= s["below"], i).otherwise(s["k"]).alias("k"), s["u"].alias("u"), s["mean"].alias("mean"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step, lambda s: s["k"])


def poisson_count(seed: int, key: Column, mean: Column) -> Column:
    """A count of the Poisson distribution of any mean: the sum of as many draws of one share of it each as keep that within the highest mean of a draw."""
    parts = F.greatest(F.ceil(mean / HIGHEST_MEAN), F.lit(1)).cast("int")
    start = F.struct(F.lit(0).alias("n"), key.alias("key"), (mean / parts).alias("share"))  # as above, the lambda reads no outer column

    def draw(s: Column, i: Column) -> Column:
        u = F.when(i == 1, hashed_unit(F.lit(str(seed)), s["key"])).otherwise(hashed_unit(F.lit(f"{seed}/part"), s["key"], i.cast("string")))
        return F.struct((s["n"] + poisson_inverse(u, s["share"])).alias("n"), s["key"].alias("key"), s["share"].alias("share"))

    return F.aggregate(F.sequence(F.lit(1), parts), start, draw, lambda s: s["n"])


def source_means(docs: DataFrame, weights: dict[str, float] | None, alpha: float, size: float) -> DataFrame:
    """``source, mean``: how often a document of each source is to come.

    Targets are shares of all characters: the given weights, or the sources' own shares to the power
    ``alpha``; ``size`` is the characters wanted, in multiples of the input's.
    """
    own = docs.groupBy("_source").agg(F.sum("_size").cast("double").alias("have"))
    if weights is None:
        own = own.withColumn("weight", F.pow("have", F.lit(alpha)))
    else:
        pairs = [F.lit(x) for pair in weights.items() for x in pair]
        own = own.withColumn("weight", F.coalesce(F.try_element_at(F.create_map(*pairs), "_source"), F.lit(0.0)))
    own = written(own, "sources")
    have, weight = own.agg(F.sum("have"), F.sum(F.col("weight").cast("decimal(38,12)")).cast("double")).first()  # two numbers, whatever the order of their sums
    mean = F.try_divide(F.col("weight") * F.lit(have) * size, F.lit(weight) * F.col("have"))
    return own.select("_source", F.coalesce(mean, F.lit(0.0)).alias("_mean"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0, seed: int = 42) -> DataFrame:
    """Documents repeated or left out so that each source comes to its target share of the characters.

    A document's count inverts the Poisson distribution with its source's mean at a hash of seed and id
    (a mean over 16 in equal parts, each at a hash of its own, summed); it is exploded by the count, and the copies are dealt over the cluster in the order of a hash.
    Returns the columns of ``docs`` and ``copy`` (int, from 0) and ``shuffle_key`` (double; the rows are
    in its order across the output's partitions). A null source is a source of its own (under ``weights``
    it has weight 0), a null text has one character, as an empty one, so that no mean is infinite; a null
    id hashes as an empty string; repeated rows of one id get one count; no rows give none. Columns of
    ``docs`` named ``copy`` or ``shuffle_key`` are replaced.
    """
    source, size_of = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null")), F.greatest(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1)).cast("long")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    sized = docs.select(F.struct(*docs.drop("copy", "shuffle_key").columns).alias("_row"), source.alias("_source"), size_of.alias("_size"), key.alias("_key"))
    named = None if weights is None else {f"={k}": float(v) for k, v in weights.items()}
    means = source_means(sized.select("_source", "_size"), named, alpha, size)
    counted = sized.join(means, "_source").withColumn("_n", poisson_count(seed, F.col("_key"), F.col("_mean")))
    copies = counted.where("_n > 0").select("_row", "_key", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_copy"))
    out = copies.select("_row.*", F.col("_copy").alias("copy"), hashed_unit(F.lit(f"{seed}/shuffle"), F.col("_key"), F.col("_copy").cast("string")).alias("shuffle_key"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(parts, F.floor(F.col("shuffle_key") * parts).cast("int")).sortWithinPartitions("shuffle_key")
