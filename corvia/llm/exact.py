"""Exact dedup by a cuckoo-filter index of live digests (Fan et al., 2014), a shard a task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import parts_for, written

#: The bytes that do not count.
BLANKS = bytes((0x20, *range(0x09, 0x0E)))


class CuckooIndex:
    """A cuckoo filter whose buckets also hold what the tags stand for.

    A key (a digest) has a 16-bit tag and two buckets; the second follows from the first and the tag, so
    that an entry can move without its key. A tag that is met is verified against the key in its slot. An
    insertion that displaces more than ``MOST_KICKS`` entries has overflown the table: it is built anew
    from the stored keys, twice as large.
    """

    SLOTS, MOST_KICKS = 4, 128

    def __init__(self, buckets: int = 256, tag_bits: int = 16):
        self.tag_mask = (1 << tag_bits) - 1
        self.live = 0
        self._clear(1 << (buckets - 1).bit_length())

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.tags, self.keys, self.values = ([x] * (buckets * self.SLOTS) for x in (0, None, None))

    def _tag(self, key: bytes) -> int:
        return (int.from_bytes(key[8:12], "little") & self.tag_mask) or 1

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ tag * 0x5BD1E995) & (self.buckets - 1)

    def _slots(self, bucket: int) -> range:
        return range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS)

    def find(self, key: bytes) -> int:
        """The slot of a live key, or -1."""
        tag = self._tag(key)
        one = int.from_bytes(key[:8], "little") & (self.buckets - 1)
        for bucket in (one, self._other(one, tag)):
            for slot in self._slots(bucket):
                if self.tags[slot] == tag and self.keys[slot] == key:
                    return slot
        return -1

    def put(self, key: bytes, value: tuple) -> None:
        """Insert a key that is not live."""
        self.live += 1
        waiting = [(key, value)]
        while waiting:
            left = self._place(*waiting.pop())
            if left:
                waiting += [left, *self.entries()]
                self._clear(2 * self.buckets)

    def _place(self, key: bytes, value: tuple) -> tuple | None:
        """Put an entry somewhere; what is left over if the table has overflown."""
        tag = self._tag(key)
        bucket = int.from_bytes(key[:8], "little") & (self.buckets - 1)
        for at in (bucket, self._other(bucket, tag)):
            for slot in self._slots(at):
                if not self.tags[slot]:
                    self.tags[slot], self.keys[slot], self.values[slot] = tag, key, value
                    return None
        for kick in range(self.MOST_KICKS):
            slot = bucket * self.SLOTS + kick % self.SLOTS
            (tag, key, value), (self.tags[slot], self.keys[slot], self.values[slot]) = (self.tags[slot], self.keys[slot], self.values[slot]), (tag, key, value)
            bucket = self._other(bucket, tag)
            for slot in self._slots(bucket):
                if not self.tags[slot]:
                    self.tags[slot], self.keys[slot], self.values[slot] = tag, key, value
                    return None
        return key, value

    def delete(self, key: bytes) -> bool:
        """Whether the key was live; it is not any more."""
        slot = self.find(key)
        if slot >= 0:
            self.tags[slot], self.keys[slot], self.values[slot] = 0, None, None
            self.live -= 1
        return slot >= 0

    def entries(self) -> Iterator[tuple[bytes, tuple]]:
        return ((k, v) for k, v in zip(self.keys, self.values) if k is not None)


def digests(docs: DataFrame, text_col: str, *others: str) -> DataFrame:
    """``others`` and ``n_chars, digest``: the code points of the whole text, and the SHA-256 of it without white space; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, n, text = batch.columns
            hashed = [hashlib.sha256(x.as_py().translate(None, BLANKS)).digest() for x in text]
            yield pa.RecordBatch.from_arrays([*kept, n, pa.array(hashed, pa.binary())], [*others, "n_chars", "digest"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*others, F.length(text).cast("long").alias("n_chars"), F.encode(text, "UTF-8").alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(others)])
    return rows.mapInArrow(run, f"{kept}, n_chars long, digest binary")


ENTRY = "digest binary, size long, n_chars long, id long, row long"


def _order(x: tuple) -> tuple:
    return -x[1], x[2] is None, x[2] or 0, x[3]


def better(a: tuple, b: tuple) -> tuple:
    """Of two representatives, the one with more code points, then of smaller id (none comes last), then the first row; sizes add up."""
    return (a[0] + b[0], *(a if _order(a) <= _order(b) else b)[1:])


def indexed(combine: Callable[[tuple, tuple], tuple], most_live: int | None = None, dead: Callable[[tuple], bool] = lambda value: False) -> Callable:
    """A task over rows of ``ENTRY`` that are led through an index: a digest not live is inserted, a live one takes the combined value, and is deleted once that is ``dead``.

    A task that only combines before a shuffle passes on and forgets its entries at ``most_live`` of them.
    """

    def flushed(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
        rows = [(k, *v) for k, v in index.entries()]
        for at in range(0, len(rows), 8192):
            columns = zip(*rows[at : at + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.binary(), *[pa.int64()] * 4))], ["digest", "size", "n_chars", "id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for key, *value in zip(*(c.to_pylist() for c in batch.columns)):
                slot, value = index.find(key), tuple(value)
                if slot < 0:
                    if not dead(value):
                        index.put(key, value)
                    continue
                index.values[slot] = combine(index.values[slot], value)
                if dead(index.values[slot]):
                    index.delete(key)
            if most_live and index.live >= most_live:
                yield from flushed(index)
                index = CuckooIndex()
        yield from flushed(index)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 200_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are identical without white space (null is empty). Of equal ones the row of
    most code points stays, then the one of smallest id (null last), then the first such row; so of rows
    that repeat id and text one is kept. Digests are led through a cuckoo index twice: where rows are
    read, so that a text that a third of the rows repeat leaves each task once, and then in shards of
    about ``shard_rows`` digests. The groups' representatives go back to the rows by a join; those of groups
    with a thousandth of all rows or more, which are a thousand at most, are broadcast. No rows give
    none; other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = written(digests(own, "text", "id", "row"), "digests")
    total = rows.count()
    entries = rows.select("digest", F.lit(1).cast("long").alias("size"), "n_chars", "id", "row")
    local = entries.mapInArrow(indexed(better, shard_rows), ENTRY)
    groups = written(local.repartition(parts_for(spark, total, shard_rows), "digest").mapInArrow(indexed(better), ENTRY), "groups")
    named = groups.select("digest", "size", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"))
    large = F.col("size") >= max(1000, -(-total // 1000))
    hot = F.broadcast(named.where(large))
    found = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(named.where(~large), "digest"))
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def live_digests(stored: DataFrame | None, changes: DataFrame, text_col: str = "text", change_col: str = "change", shard_rows: int = 200_000) -> DataFrame:
    """``digest, live``: the digests that are live after ``changes`` (rows that come, 1, or go, -1) to a table ``stored`` that this made before.

    ``live`` counts the rows of a digest. In each shard, stored and new digests are inserted first, then
    what goes is taken off; a digest without rows is deleted from the index, and one that goes
    without being there changes nothing. Null changes are left out.
    """
    spark = changes.sparkSession
    blank = [F.lit(None).cast("long").alias(c) for c in ("n_chars", "id", "row")]
    came = digests(changes.where(F.col(change_col).isNotNull()).select(F.col(change_col).cast("long").alias("size"), F.col(text_col).cast("string").alias("text")), "text", "size")
    add = lambda a, b: (a[0] + b[0], *a[1:])
    # coming and going rows are combined apart, so that the order of arrival within a task does not matter
    netted = [came.where(w).select("digest", "size", *blank).mapInArrow(indexed(add, shard_rows), ENTRY) for w in ("size > 0", "size < 0")]
    entries = netted[0].unionByName(netted[1])
    if stored is not None:
        entries = entries.unionByName(stored.select("digest", F.col("live").alias("size"), *blank))
    n = (stored.count() if stored is not None else 0) + changes.count()
    dealt = entries.repartition(parts_for(spark, n, shard_rows), "digest").sortWithinPartitions(F.desc("size"))
    return dealt.mapInArrow(indexed(add, dead=lambda value: value[0] <= 0), ENTRY).select("digest", F.col("size").alias("live"))
