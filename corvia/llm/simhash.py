"""SimHash near-duplicates found by anchor-point covering (Afrati et al., "Fuzzy joins using MapReduce", 2012)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import written
from corvia.llm.graph import components


class Code(NamedTuple):
    """A cyclic covering code on ``length`` bits, ``free`` further bits as they are; without a generator every word is an anchor."""

    length: int
    generator: int = 0
    radius: int = 0
    free: int = 0

    def remainder(self, word: int) -> int:
        degree = self.generator.bit_length() - 1
        for i in range(self.length - 1, degree - 1, -1):
            if word >> i & 1:
                word ^= self.generator << (i - degree)
        return word


#: Generator polynomials and covering radii of the binary Golay code and of the Hamming code of 15 bits.
GOLAY = Code(23, 0b110001110101, 3)
HAMMING = Code(15, 0b10011, 1)
#: From so many different fingerprints on, codes with 64 times the anchors take the Golay codes' place: each fingerprint goes to three times the anchors, at which a sixteenth as many others wait.
MANY = 4_000_000


def layout(max_bits: int, many: bool = False) -> list[tuple[int, Code, int]]:
    """The blocks of a fingerprint, ``(first bit, code, reach)``: the sum of (reach + 1) exceeds ``max_bits``, so any pair within that has a block within its reach."""
    if max_bits > 4:
        blocks = [(16 * i, HAMMING._replace(free=1)) for i in range(4)]
    elif many:
        blocks = [(0, HAMMING._replace(free=7)), (22, HAMMING._replace(free=6)), (43, HAMMING._replace(free=6))]
    else:
        blocks = [(0, GOLAY), (23, GOLAY), (46, Code(18))]
    coded = [i for i, (_, code) in enumerate(blocks) if code.generator]
    spare = max(0, max_bits + 1 - len(blocks))
    reach = {i: spare // len(coded) + (n < spare % len(coded)) for n, i in enumerate(coded)}
    return [(low, code, reach.get(i, 0)) for i, (low, code) in enumerate(blocks)]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash of each word shingle in order, words lower-cased in A-Z only; fewer words are one shingle, no words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)


def simhash(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles (repeats count); no words give 0."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id, fp`` (signed 64-bit) of every row, whole texts; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


@lru_cache
def coset_patterns(code: Code, reach: int) -> list[np.ndarray]:
    """For each syndrome, the differences to all codewords within covering radius plus ``reach``, the nearest first."""
    columns = [code.remainder(1 << i) for i in range(code.length)] + [0] * code.free
    found: list[list[int]] = [[] for _ in range(1 << code.generator.bit_length() - 1)]
    for weight in range(code.radius + reach + 1):
        for bits in combinations(range(len(columns)), weight):
            flipped = sum(i >= code.length for i in bits)
            if flipped > reach or weight - flipped > code.radius + reach - flipped:
                continue
            syndrome, word = 0, 0
            for i in bits:
                syndrome ^= columns[i]
                word |= 1 << i
            found[syndrome].append(word)
    return [np.array(x, np.int64) for x in found]


def anchored(fps: np.ndarray, max_bits: int, many: bool = False) -> pd.DataFrame:
    """Each fingerprint at its anchors: ``row, block, anchor, home``; home is the nearest anchor of the block."""
    out = []
    for block, (low, code, reach) in enumerate(layout(max_bits, many)):
        part = (fps >> np.uint64(low) & np.uint64((1 << code.length + code.free) - 1)).astype(np.int64)
        if not code.generator:
            out.append((np.arange(len(fps)), np.full(len(fps), block), part, np.ones(len(fps), bool)))
            continue
        syndrome = np.zeros(len(fps), np.int64)
        for i in range(code.length):
            syndrome ^= np.where(part >> i & 1, code.remainder(1 << i), 0)
        table = coset_patterns(code, reach)
        sizes = np.array([len(x) for x in table])
        firsts, flat = np.concatenate(([0], np.cumsum(sizes)[:-1])), np.concatenate(table)
        n = sizes[syndrome]
        row = np.repeat(np.arange(len(fps)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        out.append((row, np.full(len(row), block), part[row] ^ flat[firsts[syndrome[row]] + nth], nth == 0))
    return pd.DataFrame({k: np.concatenate([x[i] for x in out]) for i, k in enumerate(("row", "block", "anchor", "home"))})


def at_home(fps: np.ndarray, block: int, anchor: int, max_bits: int, many: bool = False) -> np.ndarray:
    """Whether ``anchor`` is the nearest of its block to each fingerprint."""
    low, code, _ = layout(max_bits, many)[block]
    off = (fps >> np.uint64(low) & np.uint64((1 << code.length + code.free) - 1)).astype(np.int64) ^ anchor
    return (np.bitwise_count(off & (1 << code.length) - 1) <= code.radius) & (off >> code.length == 0)


def forest(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, root) that connect the same of ``n`` nodes as the edges src-dst."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[src], label[dst])
        np.minimum.at(label, src, low)
        np.minimum.at(label, dst, low)
        label = label[label]
        if (label == before).all():
            break
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def linked_classes(classes: DataFrame, max_bits: int = 4, unit: int = 1024, bucket_rows: int = 16384, many: int = MANY) -> DataFrame:
    """Edges ``src, dst`` between the nodes of ``classes`` (``node, fp``: distinct fingerprints) within ``max_bits``.

    A fingerprint goes to every anchor within covering radius plus reach, per block; at each anchor those
    at home there are compared with all. A forest of each comparison is returned: no link between
    components is lost, and a group of n fingerprints gives under n edges. From ``many`` fingerprints on,
    the anchors are those of larger codes; the links are the same.
    """
    large = max_bits <= 4 and classes.count() >= many

    def places(fps: np.ndarray) -> pd.DataFrame:
        x = anchored(fps.view(np.uint64), max_bits, large)
        return x.assign(anchor=x.block.to_numpy() << 23 | x.anchor.to_numpy())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                anchor, n = np.unique(places(batch.column(0).to_numpy(zero_copy_only=False)[at : at + 4096]).anchor.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])

    # the anchors are those of the codes, at most 600,000 whatever the input
    sizes = {r.anchor: r.n for r in classes.select("fp").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).collect()}
    chunks_of = {k: -(-n // unit) for k, n in sizes.items() if n > unit}
    hot, hot_chunks = np.array(sorted(chunks_of), np.int64), np.array([chunks_of[k] for k in sorted(chunks_of)], np.int64)
    buckets = sum(n * chunks_of.get(k, 1) for k, n in sizes.items()) // bucket_rows + 1

    def chunked(fps: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        return (fps.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).to_numpy(zero_copy_only=False)[at : at + 4096]
                x = places(fps)
                anchor, fp, n = x.anchor.to_numpy(), fps[x.row.to_numpy()], np.ones(len(x), np.int64)
                if len(hot):
                    i = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                    n = np.where(hot[i] == anchor, hot_chunks[i], 1)
                own = chunked(fp, n)
                row = np.repeat(np.arange(len(n)), n)
                other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                low, high = np.minimum(own[row], other), np.maximum(own[row], other)
                key = anchor[row] << 36 | low << 18 | high
                yield pa.RecordBatch.from_arrays([pa.array(((key * 0x9E3779B1) >> 20) % buckets), pa.array(key), pa.array(fp[row])], ["bucket", "key", "fp"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf.key.to_numpy(), kind="stable")
        key, fps = pdf.key.to_numpy()[order], pdf.fp.to_numpy()[order]
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if j - i < 2:
                continue
            fp, anchor = fps[i:j], int(key[i]) >> 36
            at = np.flatnonzero(at_home(fp.view(np.uint64), anchor >> 23, anchor & (1 << 23) - 1, max_bits, large))
            bits = np.bitwise_count(fp[at].view(np.uint64)[:, None] ^ fp.view(np.uint64)[None, :])
            near = bits <= max_bits
            if int(key[i]) >> 18 & 0x3FFFF != int(key[i]) & 0x3FFFF:
                chunk = chunked(fp, np.full(j - i, chunks_of[anchor]))
                near &= chunk[at][:, None] != chunk[None, :]
            r, c = np.nonzero(near)
            member, root = forest(at[r], c, j - i)
            found.append((fp[member], fp[root]))
        return pd.DataFrame(dict(zip(("a", "b"), map(np.concatenate, zip(*found)))))

    links = written(classes.select("fp").mapInArrow(spread, "bucket long, key long, fp long").groupBy("bucket").applyInPandas(compare, "a long, b long").distinct(), "pairs")
    named = lambda end, name: classes.select(F.col("fp").alias(end), F.col("node").alias(name))
    return links.join(named("a", "src"), "a").join(named("b", "dst"), "b").select("src", "dst")


def simhash_near_dup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits. ``component_id`` is the
    smallest id reachable, the document's own included. Equal fingerprints are one class before any
    comparison. A null or wordless text has fingerprint 0 and links like any other; a row whose id is null
    is returned with a null component and links nothing; repeated rows are returned as often as they come; an empty table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fp")
    classes = written(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")).select("node", "fp"), "classes")
    found = components(linked_classes(classes, max_bits))
    named = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
