"""A limiter of requests that keeps no client's name: keyed hashes, fixed windows, and least recent clients forgotten."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvia.functions.text import hmac_sha256
from corvia.streaming.logs import with_rocksdb


class Counters:
    """Counts of one window, the most recent client last; at most ``most`` clients."""

    def __init__(self, most: int, window: int = -1, counts: Iterator[tuple[str, int]] = ()):
        self.most, self.window, self.counts = most, window, OrderedDict(counts)

    def count(self, client: str, window: int) -> int:
        if window > self.window:
            self.window = window
            self.counts.clear()
        n = self.counts.pop(client, 0) + 1
        self.counts[client] = n
        while len(self.counts) > self.most:
            self.counts.popitem(last=False)
        return n


class Limiter(StatefulProcessor):
    def __init__(self, limit: int, most: int, seconds: int):
        self.limit, self.most, self.seconds = limit, most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "window long")
        self.counts = handle.getListState("counts", "client string, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        window = self.window.get()[0] if self.window.exists() else -1
        seen = Counters(self.most, window, self.counts.get() if self.counts.exists() else ())
        for frame in rows:
            frame = frame.sort_values(["ms", "request_id"], kind="stable")
            n = [seen.count(c, int(t) // (1000 * self.seconds)) for c, t in zip(frame.client, frame.ms)]
            yield pd.DataFrame({"request_id": frame.request_id.to_numpy(), "n": n, "allowed": [x <= self.limit for x in n]})
        self.window.update((seen.window,))
        self.counts.put(list(seen.counts.items()))

    def close(self) -> None:
        pass


def limited(requests: DataFrame, secret: bytes, limit: int = 60, seconds: int = 60, most_clients: int = 4096, shards: int = 16) -> DataFrame:
    """``request_id, n, allowed`` of a stream of ``request_id, client, bucket, ts``: whether a request is among the first ``limit`` of its client and bucket in its window.

    Clients are known by a keyed hash alone. They are dealt over ``shards`` states, each of which holds the
    counts of one window and at most its share of ``most_clients``; who was there least recently is
    forgotten first, and counts from one again. A late request counts in the window that is open.
    """
    with_rocksdb(requests.sparkSession)
    named = F.concat(F.coalesce("client", F.lit("")), F.lit("\0"), F.coalesce("bucket", F.lit("")))
    hashed = requests.select("request_id", hmac_sha256(named, secret).alias("client"), F.unix_millis("ts").alias("ms"))
    dealt = hashed.withColumn("shard", F.pmod(F.xxhash64("client"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").transformWithStateInPandas(Limiter(limit, max(1, most_clients // shards), seconds), "request_id long, n long, allowed boolean", "append", "None")
