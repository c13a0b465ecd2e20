"""Sinks whose bytes depend on the rows alone, and publishing all or nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, key: str) -> None:
    """JSON lines, members by name, rows by ``key`` across the files; null members are written."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).select(line.alias("value")).write.text(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, checked: Callable[[str], None] = lambda staged: None) -> None:
    """Write all tables and swap them into ``folder``, or leave it as it was.

    Tables are written beside the folder first and ``checked`` may raise; then each takes its place by a
    rename, the former one kept until all have; whatever fails puts the former ones back.
    """
    jvm, stage = spark._jvm, f"{folder}.staged-{uuid.uuid4().hex}"
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    moved: list[tuple[str, str | None]] = []

    def rename(a: str, b: str) -> None:
        if not fs.rename(path(a), path(b)):
            raise OSError(f"{a} could not become {b}")

    try:
        for name, df in tables.items():
            df.write.parquet(f"{stage}/new/{name}")
        checked(f"{stage}/new")
        fs.mkdirs(path(folder))
        fs.mkdirs(path(f"{stage}/old"))
        for name in tables:
            former = f"{stage}/old/{name}" if fs.exists(path(f"{folder}/{name}")) else None
            if former:
                rename(f"{folder}/{name}", former)
            moved.append((name, former))
            rename(f"{stage}/new/{name}", f"{folder}/{name}")
    except BaseException:
        for name, former in reversed(moved):
            fs.delete(path(f"{folder}/{name}"), True)
            if former:
                rename(former, f"{folder}/{name}")
        raise
    finally:
        fs.delete(path(stage), True)
