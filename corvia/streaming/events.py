"""An event log with a version check, hashes seen before, and a cycle for each batch of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The most events of a packet.
MOST_EVENTS = 256


def accepted(versions: list[int], now: int) -> tuple[list[bool], int]:
    """Which appends go through, each of which expects the version it was made on, and the version after them."""
    out = []
    for expected in versions:
        out.append(expected == now and now < MOST_EVENTS)
        now += out[-1]
    return out, now


def event_log(events: DataFrame) -> DataFrame:
    """``packet, event_id, accepted, version`` of a stream of ``packet, event_id, expected``: an append that expects another version than the packet's, or comes after the last that fits, is refused. The state is one number a packet."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0
        for rows in frames:  # one after the other: a packet with very many rows is never whole in memory
            rows = rows.sort_values("event_id", kind="stable")
            good, after = accepted(rows.expected.tolist(), now)
            version = now + pd.Series(good, dtype="int64").cumsum()
            now = after
            yield pd.DataFrame({"packet": key[0], "event_id": rows.event_id.to_numpy(), "accepted": good, "version": version.to_numpy()})
        state.update((now,))

    return events.groupBy("packet").applyInPandasWithState(step, "packet long, event_id long, accepted boolean, version long", "version long", "append", GroupStateTimeout.NoTimeout)


def new_hashes(docs: DataFrame, seconds: str, late: str = "1 hour") -> DataFrame:
    """The rows of a stream whose content no row before has, within the watermark: the state holds hashes, no texts."""
    return docs.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark(seconds, late).dropDuplicatesWithinWatermark(["hash"])


def cycle(baseline: DataFrame, by: str, threshold: float, put: Callable[[str, int, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: snapshot, audit, drift against the ``baseline`` (``by, rate``), review queue; ``put`` stores each table of a batch under its number, so that a batch that runs twice is stored once."""

    def run(batch: DataFrame, number: int) -> None:
        put("snapshot", number, batch)
        audit = batch.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("flag").cast("double")).alias("rate"))
        put("audit", number, audit)
        moved = audit.join(baseline.select(by, F.col("rate").alias("before")), by, "full_outer")
        drift = moved.select(by, (F.coalesce("rate", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))).alias("delta"))
        put("drift", number, drift)
        put("queue", number, batch.join(drift.where(F.abs("delta") > threshold), by, "left_semi"))

    return run
