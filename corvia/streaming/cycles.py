"""A monitoring cycle for each batch of a stream: tables are staged one by one with receipts, and shown together."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.operators.corpus import digest


class Folder:
    """Small files in a folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def put(self, name: str, content: dict) -> None:
        """Written beside its place and moved there, so that it is whole or not there."""
        draft = self.path(f"{self.root}/{name}.draft")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        self.fs.delete(self.path(f"{self.root}/{name}"), False)
        if not self.fs.rename(draft, self.path(f"{self.root}/{name}")):
            raise OSError(f"no receipt {name}")

    def get(self, name: str) -> dict | None:
        if not self.fs.exists(self.path(f"{self.root}/{name}")):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/{name}").first().value)

    def names(self, name: str) -> list[str]:
        at = self.path(f"{self.root}/{name}")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []


def receipt(table: DataFrame) -> dict:
    """What a stored table is known by: its rows and a digest that no order changes."""
    found = digest(table, F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"})).first()
    return {"rows": found.n, "digest": found.digest}


def resumable_cycle(baseline: DataFrame, by: str, threshold: float, folder: str, before: Callable[[str, int], None] = lambda table, number: None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: snapshot, audit, drift against the ``baseline`` (``by, rate``), review queue of each batch.

    Each table is staged under ``folder/batch=<number>`` and gets a receipt once it is whole; later tables
    are made of the staged ones. A batch that runs again after a failure takes over the tables whose receipt
    they still fit and makes the others; then the batch is published, by one file, and not made again.
    ``before`` is told of each table before it is made.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files, stage = Folder(spark, folder), f"batch={number}"
        if files.get(f"_published/{number}") is not None:
            return
        receipts = {}

        def staged(name: str, make: Callable[[], DataFrame]) -> DataFrame:
            path, known = f"{folder}/{stage}/{name}", files.get(f"_receipts/{number}-{name}")
            if known is None or receipt(spark.read.parquet(path)) != known:
                before(name, number)
                make().write.mode("overwrite").parquet(path)
                known = receipt(spark.read.parquet(path))
                files.put(f"_receipts/{number}-{name}", known)
            receipts[name] = known
            return spark.read.parquet(path)

        snapshot = staged("snapshot", lambda: batch)
        audit = staged("audit", lambda: snapshot.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("flag").cast("double")).alias("rate")))

        def moved() -> DataFrame:
            both = audit.join(baseline.select(by, F.col("rate").alias("before")), by, "full_outer")
            return both.select(by, "rate", "before", (F.coalesce("rate", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))).alias("delta"))

        drift = staged("drift", moved)
        staged("queue", lambda: snapshot.join(F.broadcast(drift.where(F.abs("delta") > threshold).select(by)), by, "left_semi"))
        before("published", number)
        files.put(f"_published/{number}", receipts)

    return run


def published(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """A table of all published batches, with ``batch``; None before the first. What is staged and not published is not seen."""
    numbers = Folder(spark, folder).names("_published")
    paths = [f"{folder}/batch={n}/{table}" for n in numbers if n.isdigit()]
    return spark.read.option("basePath", folder).parquet(*paths) if paths else None
