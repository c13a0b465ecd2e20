"""Logs, limiter and cycles across restarts; CSV by header, text by mark and name."""

from __future__ import annotations

import hashlib
import hmac
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvia.functions.text import hmac_sha256
from corvia.sources import files
from corvia.streaming.cycles import published, resumable_cycle
from corvia.streaming.events import MOST_EVENTS
from corvia.streaming.limits import Counters, limited
from corvia.streaming.logs import Log, packet_log

EVENTS = "packet long, event_id long, expected long, resolves long, ts timestamp"


def run(stream, folder, name: str) -> None:
    """One run to the end of what is there, from the checkpoint of the run before."""
    out = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-c").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()


def test_log_rules():
    log = Log()
    assert [log.append(*x) for x in ((1, 0, None), (1, 1, None), (2, 0, None), (2, 1, 1), (3, 2, 1), (3, 2, 9), (3, 2, 2))] == ["accepted", "repeated", "stale", "accepted", "unknown", "unknown", "accepted"]
    assert log.version == 3 and log.open == 1
    log = Log(MOST_EVENTS, ((i, None) for i in range(MOST_EVENTS)))
    assert log.append(-1, MOST_EVENTS, None) == "full"


def test_packet_log_across_a_restart(spark, tmp_path):
    source = str(tmp_path / "in")

    def put(rows):
        spark.createDataFrame(rows, "packet long, event_id long, expected long, resolves long, minute long").select("packet", "event_id", "expected", "resolves", F.timestamp_seconds(F.col("minute") * 60).alias("ts")).coalesce(1).write.mode("append").parquet(source)

    stream = lambda: packet_log(spark.readStream.schema(EVENTS).parquet(source), late="1 minute", idle_ms=600_000)
    put([(1, 1, 0, None, 1), (1, 2, 0, None, 2), (1, 3, 1, 1, 3), (2, 4, 0, None, 3), (2, 5, 1, 99, 4)])
    run(stream(), tmp_path, "log")
    put([(1, 6, 2, 1, 5), (1, 7, 2, 3, 6), (2, 4, 1, None, 6), (2, 8, 1, 4, 6)])  # after a restart: versions, ids and links are still known
    run(stream(), tmp_path, "log")
    put([(3, 9, 0, None, 60)])
    run(stream(), tmp_path, "log")
    put([(1, 10, 0, None, 61), (3, 11, 1, 9, 61)])  # the idle logs are closed by now
    run(stream(), tmp_path, "log")
    found = Counter((r.packet, r.event_id, r.state, r.version, r.open) for r in spark.read.parquet(f"{tmp_path}/log").collect())
    assert found == Counter(
        [
            (1, 1, "accepted", 1, 1), (1, 2, "stale", 1, 1), (1, 3, "accepted", 2, 1), (2, 4, "accepted", 1, 1), (2, 5, "unknown", 1, 1),
            (1, 6, "unknown", 2, 1), (1, 7, "accepted", 3, 1), (2, 4, "repeated", 1, 1), (2, 8, "accepted", 2, 1),
            (3, 9, "accepted", 1, 1), (1, None, "closed", 3, 1), (2, None, "closed", 2, 1),
            (1, 10, "accepted", 1, 1), (3, 11, "accepted", 2, 1),
        ]
    )


def test_hmac(spark):
    rows = [("",), ("a",), ("é日",), ("x" * 300,)]
    for key in (b"", b"key", bytes(range(256))):
        found = spark.createDataFrame(rows, "t string").select("t", hmac_sha256(F.col("t"), key).alias("h")).collect()
        assert all(r.h == hmac.new(key, r.t.encode(), hashlib.sha256).hexdigest() for r in found)


def test_counters_forget_the_least_recent():
    seen = Counters(2)
    assert [seen.count(c, 1) for c in "abab"] == [1, 1, 2, 2]
    assert [seen.count(c, 1) for c in "cab"] == [1, 1, 1]  # a was least recent when c came, b when a came
    assert [seen.count(c, w) for c, w in (("b", 2), ("b", 1))] == [1, 2] and len(seen.counts) == 1


def test_limiter_across_a_restart(spark, tmp_path):
    source, rng = str(tmp_path / "in"), random.Random(3)
    rows = [(i, rng.choice(["u", "v", "w", None]), rng.choice(["a", "b"]), 600 + i // 2) for i in range(300)]
    stream = lambda: limited(spark.readStream.schema("request_id long, client string, bucket string, ts timestamp").parquet(source), b"secret", limit=3, seconds=20, shards=4)
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, "request_id long, client string, bucket string, s long").select("request_id", "client", "bucket", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        run(stream(), tmp_path, "limited")
    n, want = Counter(), {}
    for i, client, bucket, s in rows:
        n[client, bucket, s // 20] += 1
        want[i] = (n[client, bucket, s // 20], n[client, bucket, s // 20] <= 3)
    assert {r.request_id: (r.n, r.allowed) for r in spark.read.parquet(f"{tmp_path}/limited").collect()} == want


@pytest.mark.parametrize("fails", ["audit", "drift", "queue", "published"])
def test_cycle_resumes_between_two_tables(spark, tmp_path, fails):
    source, out, made = str(tmp_path / "in"), str(tmp_path / "out"), []
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", i % 4 == 1) for i in range(20)], "id long, kind string, flag boolean")
    df.coalesce(1).write.parquet(source)
    baseline = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 1.0)], "kind string, rate double")

    def start(before):
        stream = spark.readStream.schema(df.schema).parquet(source).writeStream.foreachBatch(resumable_cycle(baseline, "kind", 0.2, out, before))
        return stream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()

    def stop(table, number):
        if table == fails:
            raise RuntimeError("killed")
        made.append(table)

    with pytest.raises(Exception, match="killed"):
        start(stop).awaitTermination()
    assert published(spark, out, "snapshot") is None
    order, again = ["snapshot", "audit", "drift", "queue", "published"], []
    assert made == order[: order.index(fails)]
    start(lambda table, number: again.append(table)).awaitTermination()
    assert again == order[order.index(fails) :]
    assert published(spark, out, "snapshot").count() == 20
    assert {(r.kind, r.delta) for r in published(spark, out, "drift").collect()} == {("a", 0.5), ("b", 0.0), ("c", -1.0)}
    assert {(r.kind, r.batch) for r in published(spark, out, "queue").collect()} == {("a", 0)}
    resumable_cycle(baseline, "kind", 0.2, out, lambda table, number: pytest.fail("made twice"))(df.limit(1), 0)


def test_cycle_makes_a_damaged_table_anew(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", True)], "id long, kind string, flag boolean")
    baseline, out, again = spark.createDataFrame([], "kind string, rate double"), str(tmp_path / "out"), []

    def stop(table, number):
        if table == "queue":
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        resumable_cycle(baseline, "kind", 0.2, out, stop)(df, 7)
    df.limit(0).groupBy("kind").agg(F.count("id").alias("n"), F.lit(0.0).alias("rate")).write.mode("overwrite").parquet(f"{out}/batch=7/audit")
    resumable_cycle(baseline, "kind", 0.2, out, lambda table, number: again.append(table))(df, 7)
    assert again == ["audit", "queue", "published"] and published(spark, out, "audit").count() == 1


# --- files

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])


def test_csv_goes_by_its_header(spark, tmp_path):
    contents = {
        "one.csv": "a,b\nx,1\n".encode(), "two.csv": "b,a\n2,y\n".encode(), "bom.csv": "﻿b,other,a\n3,?,z\n".encode(), "breaks.csv": 'a,b\n"line one\nline two",4\n"say ""hi"", you",5\n'.encode(),
        "korean.csv": "b,a\n6,가나\n".encode("cp949"), "breaks-korean.csv": 'other,a,b\n다,"라\n마",7\n'.encode("cp949"), "empty.csv": b"", "head.csv": b"a,b\n", "bad.csv": b"a,b\n\xff\xff,8\n", "quoted.csv": b'"b","a"\n9,q\n',
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = sorted(map(tuple, files.csv(spark, str(tmp_path), SCHEMA).collect()), key=lambda r: r[1])
    assert found == [("x", 1), ("y", 2), ("z", 3), ("line one\nline two", 4), ('say "hi", you', 5), ("가나", 6), ("라\n마", 7), (found[7][0], 8), ("q", 9)]
    assert "�" in found[7][0]
    assert files.csv(spark, str(tmp_path), SCHEMA).schema == SCHEMA
    for header, what in (("a,c\n", "b 0 times"), ("a,b,b\n", "b 2 times")):
        (tmp_path / "wrong.csv").write_text(header)
        with pytest.raises(ValueError, match=what):
            files.csv(spark, str(tmp_path), SCHEMA)


def test_text_files(spark, tmp_path):
    text = "é 가 \U0001f600\r\nend"
    contents = {"plain.txt": text.encode(), "bom.txt": text.encode("utf-8-sig"), "le.txt": b"\xff\xfe" + text.encode("utf-16-le"), "be.txt": b"\xfe\xff" + text.encode("utf-16-be"), "le32.txt": b"\xff\xfe\0\0" + text.encode("utf-32-le"), "none.txt": b""}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = {r.file.rpartition("/")[2]: (r.text, r.encoding) for r in files.text_files(spark, str(tmp_path)).collect()}
    assert found == {"plain.txt": (text, "utf-8"), "bom.txt": (text, "utf-8"), "le.txt": (text, "utf-16-le"), "be.txt": (text, "utf-16-be"), "le32.txt": (text, "utf-32-le")}
    other = tmp_path / "other"
    other.mkdir()
    (other / "k.txt").write_bytes("가나".encode("cp949"))
    assert files.text_files(spark, str(other), "cp949").first().text == "가나"
    with pytest.raises(Exception, match="k.txt: byte 0"):
        files.text_files(spark, str(other)).collect()
    (other / "k.txt").write_bytes(b"\xef\xbb\xbfab\xff")
    with pytest.raises(Exception, match="k.txt: byte 5"):
        files.text_files(spark, str(other)).collect()
    with pytest.raises(Exception, match="marked as utf-8, named as utf-16"):
        files.text_files(spark, str(other), "utf-16").collect()
    with pytest.raises(LookupError):
        files.text_files(spark, str(other), "no-such")


def test_archives_of_either_kind(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    contents = {"a.txt": b"mail x@y.org", "dir/b.py": b'token = "abc"\n10.20.30.40', "c.bin": bytes(range(256)), "big.txt": b"x@y.org" * 200, "empty": b""}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, data in contents.items():
            z.writestr(name, data)
    for name, mode in (("t.tar", "w"), ("t.tgz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as t:
            t.addfile(tarfile.TarInfo("dir"), None)
            for member, data in contents.items():
                info = tarfile.TarInfo(member)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    kinds = {"a.txt": ["email"], "dir/b.py": ["assigned_secret", "ipv4"], "c.bin": [], "empty": []}
    found = files.archive_members(spark, str(tmp_path), most_bytes=1000).collect()
    want = {(a, n, len(d), None if n == "big.txt" else hashlib.sha256(d).hexdigest(), None if n == "big.txt" else tuple(kinds[n])) for a in ("z.zip", "t.tar", "t.tgz") for n, d in contents.items()}
    assert {(r.archive, r.member, r["size"], r.hash, None if r.kinds is None else tuple(r.kinds)) for r in found if r.member != "dir" or r["size"]} - {(a, "dir", 0, hashlib.sha256(b"").hexdigest(), ()) for a in ("t.tar", "t.tgz")} == want
    tree = spark.createDataFrame([("a.txt", "h"), ("gone", "h"), ("empty", hashlib.sha256(b"").hexdigest())], "member string, hash string")
    assert {tuple(r) for r in files.member_mismatches(tree, files.archive_members(spark, str(tmp_path / "z.zip"), 1000)).collect()} == {("a.txt", "different"), ("gone", "missing"), ("dir/b.py", "extra"), ("c.bin", "extra"), ("big.txt", "extra")}
    (tmp_path / "no.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="no.zip"):
        files.archive_members(spark, str(tmp_path / "no.zip")).collect()
