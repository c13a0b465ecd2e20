"""Best-fit-decreasing packing of tokenized documents into sequences of fixed length."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvia.llm.common import written

#: The added token of ``byte_bpe_50k.json``, which the rank file does not hold.
ADDED = {"<|endoftext|>": 50256}

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(ranks_path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file, once per process; the added token of the tokenizer's JSON is one id wherever its text stands."""
    if ranks_path not in _encodings:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[ranks_path] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return _encodings[ranks_path]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, ranks_path: str, end_id: int) -> DataFrame:
    """Every document's ids, ``end_id`` last, in pieces of ``capacity``; only the first piece of a document may be shorter.

    Rows ``doc_id, piece, start, length, ids_crc32, task, nth``: ``nth`` counts the pieces of that length
    before this one in its task, so that ranks need no sort of all pieces of one length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoding(ranks_path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(at, 256)
                for doc, text, task in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                    ids = np.append(enc.encode_to_numpy(text or "", allowed_special="all").astype("<u4"), np.uint32(end_id))
                    first = len(ids) % capacity or capacity
                    for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                        end = first if piece == 0 else start + capacity
                        rows.append((doc, piece, start, end - start, zlib.crc32(ids[start:end].tobytes()), task, int(seen[end - start])))
                        seen[end - start] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("task"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


class CapacityTree:
    """A segment tree over remaining capacities: which are held by open bins, and the tightest that fits, in logarithmic time."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)

    def set(self, remaining: int, bins: int) -> None:
        i = remaining + self.width
        self.open[i] = bins
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] + self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that some bin has."""
        i = need + self.width
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` items each, as runs ``(length, first rank, items, first bin, offset)``.

    Items of one length and bins of one remaining capacity are alike, so a run places many documents with
    one descent of the tree: as many items as there are bins of the tightest capacity. The work depends
    on the capacity, not on how many documents there are, and the bins are those of best-fit decreasing
    document by document.
    """
    tree, held, runs, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            space = tree.tightest(length)
            if space is None:
                space, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, most = held[space].pop()
                n = min(most, -(-left // (space // length)))
                if n < most:
                    held[space].append((first + n, most - n))
                tree.set(space, tree.open[space + tree.width] - n)
            each = space // length  # a bin takes them until no other fits: none is tighter
            placed = min(left, n * each)
            last = placed - (n - 1) * each
            for k in range(each):
                items = n if k < last else n - 1
                if items:
                    runs.append((length, rank, items, first, capacity - space + k * length))
                    rank += items
            if n > 1:
                _hold(tree, held, space - each * length, first, n - 1)
            _hold(tree, held, space - last * length, first + n - 1, 1)
            left -= placed
    return runs


def _hold(tree: CapacityTree, held: list, remaining: int, first: int, n: int) -> None:
    held[remaining].append((first, n))
    tree.set(remaining, tree.open[remaining + tree.width] + n)


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, ranks_path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Best-fit decreasing over all pieces of all documents. Only the histogram of lengths, at most
    ``capacity`` numbers, reaches the driver; the plan made from it has runs by length and remaining capacity,
    however many documents there are, and goes to the tasks with their function. A null text is empty
    and gives one piece of the end id; ids may be null or repeated, each row is packed by itself; an empty
    table gives no rows; other columns are not read.
    """
    pieces = written(token_pieces(docs, id_col, text_col, capacity, ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), end_id), "pieces")
    of_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = of_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan: dict[int, list] = {}
    for length, *run in best_fit_decreasing(counts, capacity):
        plan.setdefault(length, []).append(run)
    runs = {length: np.array(x, np.int64).T for length, x in plan.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dict(zip(batch.schema.names, batch.columns))
            length, rank = x["length"].to_numpy(), x["base"].to_numpy() + x["nth"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                ranks, _, firsts, offsets = runs[n]
                run = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at], offset[at] = firsts[run] + rank[at] - ranks[run], offsets[run]
            yield pa.RecordBatch.from_arrays([*(x[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = pieces.join(before, ["length", "task"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("doc_id", id_col)
