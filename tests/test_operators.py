"""Catalog checks, matching against brute force, streams, and the edges of the metrics."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corvia.operators import metrics as M
from corvia.operators.corpus import sample_quotas, split_quotas
from corvia.operators.rules import check, near
from corvia.plans.catalog import DEFAULT, CatalogError, Rule
from corvia.streaming.windows import admitted, latest, window_counts


def test_catalog_rejects_bad_rules():
    with pytest.raises(CatalogError, match="malformed"):
        DEFAULT.with_local([Rule("bad id", "question", "x", "low", "presence", ("a",))])
    with pytest.raises(CatalogError, match="local"):
        DEFAULT.with_local([Rule("L-X", "policy", "x", "low", "presence", ("a",), statute="privacy", article="1")])
    assert replace(DEFAULT, snapshot="2024-02-01").matching_version == DEFAULT.matching_version


def test_near():
    others = [(0, 3), (5, 9), (20, 25)]
    for a in range(0, 26):
        for b in range(a + 1, 27):
            for w in (0, 2, 7):
                want = any(s >= a - w and e <= b + w for s, e in others)
                assert near((a, b), others, w) == want


def test_check_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "mail a@b.org " * 3000), (4, "CAPS!! \U0001f600 x@y.com"), (4, "CAPS!!"), (None, "licensed under X")]
    found = check(spark.createDataFrame(rows, "doc_id long, text string").withColumn("slots", F.lit(1)).select("doc_id", "text"), DEFAULT).collect()
    assert len(found) == len(rows)
    assert all(r.counts.findings == len(r.findings) for r in found)
    assert check(spark.createDataFrame([], "doc_id long, text string"), DEFAULT).count() == 0


def test_kappa(spark):
    rows = [("a", "x", "x"), ("a", "x", "y"), ("a", "y", "y"), ("a", "y", "y"), ("b", "x", "x")]
    found = {r.g: r.kappa for r in M.kappa(spark.createDataFrame(rows, "g string, a string, b string"), "a", "b", ["g"]).collect()}
    assert found == {"a": 0.5, "b": None}


def test_quotas():
    assert sum(split_quotas({"a": 10, "b": 1, "c": 3}, 0.3).values()) == round(14 * 0.3)
    assert split_quotas({"a": 1}, 0.5) == {"a": 0}
    assert sum(sample_quotas({"a": 70, "b": 29, "c": 1}, 10).values()) == 10


def test_windows(spark, tmp_path):
    rows = [(1, "u", "2024-01-01 00:00:01", 1.0), (2, "u", "2024-01-01 00:00:30", 2.0), (3, "u", "2024-01-01 00:01:00", 3.0), (4, "v", "2024-01-01 00:00:02", 4.0), (5, "u", None, 5.0)]
    events = spark.createDataFrame(rows, "event_id long, user string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.event_id: r.allowed for r in admitted(events, "user", "ts", "event_id", limit=1).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert {r.user: r.value for r in latest(events.where("ts is not null"), ["user"], "value", ["ts", "event_id"]).collect()} == {"u": 3.0, "v": 4.0}
    events.write.parquet(f"{tmp_path}/in")
    stream = window_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "user", "ts", limit=1)
    run = stream.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {(r.user, str(r.start), r.n, r.exceeded) for r in spark.table("counted").where("start is not null").collect()} == {("u", "2024-01-01 00:00:00", 2, True), ("u", "2024-01-01 00:01:00", 1, False), ("v", "2024-01-01 00:00:00", 1, False)}
