"""Shared helpers: tables in the cluster's shared folder, packed batches, bounded units."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six bytes (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"

#: Removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, one of our own in local mode (tests), an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="corvia-"))
        spark.sparkContext.setCheckpointDir(_own_folder[0])
    return _own_folder[0]


def written(df: DataFrame, what: str = "t", codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # the shuffle files of what is written are not needed any more
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing reads any more: whatever was made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """Partitions for ``rows``: about ``per_part`` rows each, never under the session's shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_part))


def pair_units(rows: DataFrame, keys: list[str], spread: Column, unit: int, weight: Column | None = None) -> DataFrame:
    """Deal the rows of every key into units in which each pair of them meets, none much over ``2 * unit`` rows.

    A key of at most ``unit`` rows is one unit (0, 0). A larger key is cut into chunks by the hash of
    ``spread``, and chunk pairs become the units (lo, hi); its rows go to each unit of their chunk. So a
    hot key is compared by many tasks, and no task needs it whole. With ``weight``, rows count by that.
    Adds ``chunk``, ``lo`` and ``hi``.
    """
    sizes = rows.groupBy(*keys).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n")).where(F.col("_n") > unit)
    chunks = F.coalesce(F.ceil(F.col("_n") / unit), F.lit(1)).cast("int")
    return (
        rows.join(sizes, keys, "left")
        .withColumn("_k", chunks)
        .withColumn("chunk", F.pmod(F.xxhash64(spread), F.col("_k")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .withColumn("lo", F.least("chunk", "_o"))
        .withColumn("hi", F.greatest("chunk", "_o"))
        .drop("_n", "_k", "_o")
    )


def ranges_by_document(ranges: DataFrame, *fields: str) -> DataFrame:
    """``id, th`` and the list ``ranges`` of the document's different structs: no longer than the document, however often the row repeats."""
    return ranges.groupBy("id", "th").agg(F.collect_set(F.struct(*fields)).alias("ranges"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, id, th``: a document's key is its id (-1 for null) and the hash of its text, so that rows that repeat an id stay apart."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.withColumns({"id": F.coalesce("doc_id", F.lit(-1)), "th": F.xxhash64("text")})
