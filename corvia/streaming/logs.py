"""A log of review events for each packet, kept in the state store: appends are checked, links resolved, idle logs closed by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvia.streaming.events import MOST_EVENTS

#: The state store that lists and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "packet long, event_id long, state string, version long, open long"


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Log:
    """The events of one packet: ids in their order, and those that later ones have resolved."""

    def __init__(self, version: int = 0, events: Iterator[tuple[int, int | None]] = ()):
        self.version, self.ids, self.resolved, self.new = version, set(), set(), []
        for event, resolves in events:
            self.ids.add(event)
            self.resolved.add(resolves)

    def append(self, event: int, expected: int, resolves: int | None) -> str:
        """The first reason why an append is refused, or ``accepted``."""
        if event in self.ids:
            return "repeated"
        if expected != self.version:
            return "stale"
        if len(self.ids) >= MOST_EVENTS:
            return "full"
        if resolves is not None and (resolves not in self.ids or resolves in self.resolved):
            return "unknown"
        self.version += 1
        self.ids.add(event)
        self.resolved.add(resolves)
        self.new.append((event, resolves))
        return "accepted"

    @property
    def open(self) -> int:
        return len(self.ids) - len(self.resolved - {None})


class PacketLog(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "version long")
        self.events = handle.getListState("events", "event_id long, resolves long")

    def _log(self) -> Log:
        head = self.head.get() if self.head.exists() else (0,)
        return Log(head[0], self.events.get() if self.events.exists() else ())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = self._log()
        for frame in rows:  # a packet with very many rows comes in many frames
            frame = frame.sort_values("event_id", kind="stable")
            out, close_at = [], int(frame.ms.max()) + self.idle_ms
            for event, expected, resolves in zip(frame.event_id, frame.expected, frame.resolves):
                state = log.append(int(event), int(expected), None if pd.isna(resolves) else int(resolves))
                out.append((key[0], int(event), state, log.version, log.open))
            if log.new:
                self.events.appendList(log.new)
                self.head.update((log.version,))
                log.new = []
            for timer in list(self.handle.listTimers()):
                if timer < close_at:
                    self.handle.deleteTimer(timer)
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(close_at)
            yield pd.DataFrame(out, columns=["packet", "event_id", "state", "version", "open"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        log = self._log()
        self.head.clear()
        self.events.clear()
        yield pd.DataFrame({"packet": [key[0]], "event_id": pd.array([None], dtype="Int64"), "state": ["closed"], "version": [log.version], "open": [log.open]})

    def close(self) -> None:
        pass


def packet_log(events: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """``packet, event_id, state, version, open`` of a stream of ``packet, event_id, expected, resolves, ts``.

    An append states the version that it was made on and may name an event of the log that it resolves. It
    is ``accepted``, or refused as ``repeated`` (the id is in the log), ``stale`` (another version),
    ``full`` (``MOST_EVENTS`` are there) or ``unknown`` (it resolves what is not there, or not open).
    ``open`` counts the events that nothing has resolved. A log to which nothing comes for ``idle_ms`` of
    event time is ``closed``, its state goes, and the packet starts anew. The state of a packet is at most
    ``MOST_EVENTS`` pairs of ids.
    """
    with_rocksdb(events.sparkSession)
    timed = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))  # of the instant, whatever the session's time zone
    return timed.groupBy("packet").transformWithStateInPandas(PacketLog(idle_ms), OUTPUT, "append", "EventTime")
