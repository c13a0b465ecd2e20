"""Substring dedup with suffix arrays built by the linear grouping construction (Baier, "Linear-time suffix sorting", CPM 2016)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvia.llm.common import discard, keyed, ranges_by_document, written
from corvia.llm.debruijn import run_hashes

#: Bytes that are hashed together to choose the piece a string belongs to, and the most strings in a piece.
SEED_BYTES, MOST_STRINGS = 16, 512
_MIX = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def suffix_order(text: list[int]) -> list[int]:
    """The suffixes of a list of non-negative numbers in order, without recursion.

    Suffixes start in groups by their first number. Groups are taken in descending order; each member
    points to the nearest suffix before it that is in a smaller group. Those pointed to have the group's
    Lyndon prefix right after their own, as many times as they are pointed to: they leave their group for
    a new one just above it. In the end a group holds the suffixes of one longest Lyndon prefix, and the
    suffix after that prefix orders them: going up the order, each suffix emits those whose prefix ends
    before it, along the same pointers.
    """
    t = [*text, -1]
    n = len(t)
    order = sorted(range(n), key=t.__getitem__)
    place, group, size, before = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for i, s in enumerate(order):
        if i and t[s] != t[order[i - 1]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    top = n - 1
    while top >= 0:
        start = group[order[top]]
        if start == top:
            s = order[top]
            p = s - 1
            while p >= 0 and group[p] > start:
                p = before[p]
            before[s] = p
            if p >= 0 and size[group[p]] > 1:
                _raise([p], order, place, group, size)
            top -= 1
            continue
        pointed: dict[int, int] = {}
        for s in sorted(order[start : top + 1]):
            p = s - 1
            while p >= 0 and group[p] > start:
                p = before[p]
            if p >= 0 and group[p] == start:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        top = start - 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            moves.setdefault((-times, group[p]), []).append(p)
        for key in sorted(moves) if len(moves) > 1 else moves:
            _raise(moves[key], order, place, group, size)
    free, done, out = list(range(n)), bytearray(n), [0] * n
    out[0], done[n - 1] = n - 1, 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = before[s]
    return out[1:]


def _raise(members: list[int], order: list[int], place: list[int], group: list[int], size: list[int]) -> None:
    """Move members of one group into a new group right above the rest of it."""
    start = group[members[0]]
    if len(members) == size[start]:
        return
    end = start + size[start]
    for p in members:
        end -= 1
        q, at = order[end], place[p]
        order[end], order[at] = p, q
        place[p], place[q] = end, at
    for p in members:
        group[p] = end
    size[end] = len(members)
    size[start] -= len(members)


def pieces(raw: bytes, length: int, seed_bytes: int = SEED_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(seed, start, strings)`` of the pieces of a text: runs of neighbouring strings of ``length`` bytes with the same least hash of ``seed_bytes`` bytes in them. Equal strings have the same seed wherever they stand."""
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 3
    h = _MIX[np.frombuffer(raw, np.uint8)]
    if seed_bytes == SEED_BYTES:
        step = 1
        for odd in _ODD:
            h = h[:-step] * odd + h[step:]
            h ^= h >> np.uint64(29)
            step *= 2
    else:
        h = run_hashes(h, seed_bytes)
    span, least = length - seed_bytes + 1, h
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    n = np.diff(np.concatenate((starts, [len(least)])))
    if n.max() > MOST_STRINGS:
        parts = -(-n // MOST_STRINGS)
        own = np.repeat(np.arange(len(n)), parts)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, n = starts[own] + nth * MOST_STRINGS, np.minimum(n[own] - nth * MOST_STRINGS, MOST_STRINGS)
    return least[starts].view(np.int64), starts, n


def document_seeds(own: DataFrame, length: int) -> DataFrame:
    """``seed, id``: the seeds of the documents, aggregated as they are read: of each 256 documents a seed has its smallest and its largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [pieces(t.encode(), length)[0] for t in part.column(1).to_pylist()]
                seed, ids = np.concatenate(found), np.repeat(part.column(0).to_numpy(), list(map(len, found)))
                if len(seed):
                    order = np.argsort(seed)
                    seed, ids = seed[order], ids[order]
                    heads = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1])))
                    seed, low, high = seed[heads], np.minimum.reduceat(ids, heads), np.maximum.reduceat(ids, heads)
                    more = high > low
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((seed, seed[more]))), pa.array(np.concatenate((low, high[more])))], ["seed", "id"])

    return own.select("id", "text").mapInArrow(run, "seed long, id long")


def shared_pieces(own: DataFrame, length: int) -> DataFrame:
    """``seed, ph, id, th, start, n``: where the pieces stand whose seed documents of different ids have; no other string can be in two documents. ``ph`` is the hash of the piece's bytes."""
    seeds = document_seeds(own, length).repartition("seed")  # aggregated above, so Spark's own partial aggregate would find nothing before the shuffle
    shared = written(seeds.groupBy("seed").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("seed"), "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, found, hashes = batch.slice(at, 128), [], []
                for text in part.column(2).to_pylist():
                    raw = text.encode()
                    seed, start, n = pieces(raw, length)
                    found.append((seed, start, n))
                    hashes += [xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist())]
                seed, start, n = map(np.concatenate, zip(*found))
                rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x, _, _ in found]))
                ph = np.array(hashes, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(ph), part.column(0).take(rows), part.column(1).take(rows), pa.array(start.astype(np.int64) << 10 | n)], ["seed", "ph", "id", "th", "at"])

    every = own.select("id", "th", "text").mapInArrow(run, "seed long, ph long, id long, th long, at long")
    start, n = F.shiftright("at", 10).cast("int"), F.col("at").bitwiseAND(1023).cast("int")  # one number in the shuffle; a piece has at most MOST_STRINGS strings
    out = written(every.join(shared, "seed", "left_semi").select("seed", "ph", "id", "th", start.alias("start"), n.alias("n")), "places", "zstd")
    discard(shared)
    return out


def pieces_apart(own: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """``seed, ph, first, pieces, piece``: the different pieces of the seeds that have ``pieces`` of them, two or more, with their bytes, read where ``distinct`` places them."""
    many = distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1")
    at = F.struct("seed", "ph", "pieces", "start", "n")
    wanted = written(distinct.join(many, "seed").groupBy(F.col("first").alias("id"), "th").agg(F.collect_list(at).alias("at")), "at", "zstd")
    again = F.lag("id").over(Window.partitionBy("id", "th").orderBy("id"))
    once = own.select("id", "th", "text").withColumn("again", again).where("again is null").drop("again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 128):
                part = batch.slice(row, 128)
                lists = part.column(2)
                at = lists.flatten()
                own = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                seed, ph, pieces, start, n = at.flatten()
                raw = [t.encode() for t in part.column(1).to_pylist()]
                piece = [raw[i][a : a + k + length - 1] for i, a, k in zip(own.tolist(), start.to_pylist(), n.to_pylist())]
                yield pa.RecordBatch.from_arrays([seed, ph, part.column(0).take(pa.array(own)), pieces, pa.array(piece, pa.binary())], ["seed", "ph", "first", "pieces", "piece"])

    read = once.join(wanted, ["id", "th"]).select("id", "text", "at").mapInArrow(run, "seed long, ph long, first long, pieces long, piece binary")
    out = written(read, "apart", "zstd")
    discard(wanted)
    return out


def earlier_strings(members: list[bytes], first: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each piece, the runs ``(from, to)`` of its strings that also stand in a piece of a smaller ``first`` document, by the suffix array of all the pieces."""
    sizes = np.array(list(map(len, members)))
    ends = np.cumsum(sizes + 1)
    text = np.frombuffer(b"\0".join(members), np.uint8)
    numbers = text.astype(np.int64) + 1
    numbers[ends[:-1] - 1] = 0
    order = np.array(suffix_order(numbers.tolist()), np.int64)
    own = np.searchsorted(ends, order, side="right")
    whole = ends[own] - 1 - order >= length
    order, own = order[whole], own[whole]
    strings = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.zeros(len(order), bool)
    for i in range(1, len(order), 65536):
        a = slice(i, min(i + 65536, len(order)))
        same[a] = (strings[order[a]] == strings[order[a.start - 1 : a.stop - 1]]).all(1)
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(first[own], heads)[np.cumsum(~same) - 1]
    late = least < first[own]
    piece, at = own[late], order[late] - (ends - sizes - 1)[own[late]]
    sort = np.lexsort((at, piece))
    piece, at = piece[sort], at[sort]
    out: list[list[tuple[int, int]]] = [[] for _ in members]
    if len(piece):
        cut = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1), [True])))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            out[piece[i]].append((int(at[i]), int(at[j - 1]) + 1))
    return out


def repeated_runs(seeds: np.ndarray, members: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(piece, from, strings)``: the runs of strings whose hash comes twice or more in the pieces of their seed. No other string can have an equal one."""
    sizes = np.array(list(map(len, members)))
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(sizes)), sizes)[: max(0, int(ends[-1]) - length + 1)]
    at = np.flatnonzero(np.arange(len(own)) + length <= ends[own])
    hashes = run_hashes(_MIX[np.frombuffer(b"".join(members), np.uint8)], length)[at] ^ seeds.astype(np.int64).view(np.uint64)[own[at]] * _ODD[0]
    order = np.sort(hashes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return (np.zeros(0, np.int64),) * 3
    at = at[twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes]
    heads = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]]))))
    piece = own[at[heads]]
    return piece, at[heads] - (ends - sizes)[piece], np.diff(np.concatenate((heads, [len(at)])))


def runs_in_bucket(seed: np.ndarray, first: np.ndarray, members: list[bytes], length: int, array_pieces: int) -> dict[int, list[tuple[int, int]]]:
    """For the pieces of whole seeds, by number, the runs ``(from, to)`` of strings that a piece of the seed with a smaller ``first`` has as well.

    Equal runs of a seed are one in the suffix arrays, with the smallest ``first``: all its pieces but
    those of that ``first`` lose the whole run, these what the array shows.
    """
    piece, at, strings = repeated_runs(seed, members, length)
    known: dict[tuple[int, bytes], int] = {}
    places = list(zip(piece.tolist(), at.tolist(), strings.tolist()))
    which = np.array([known.setdefault((s, members[p][a : a + n + length - 1]), len(known)) for s, (p, a, n) in zip(seed[piece].tolist(), places)], np.int64)
    if not len(which):
        return {}
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, which, first[piece])
    of, text = np.array([s for s, _ in known], np.int64), [t for _, t in known]
    _, kind, n = np.unique(of, return_inverse=True, return_counts=True)
    several = np.flatnonzero(n[kind] > 1)  # the one run that a seed is left with has no other to be compared with
    order, cuts = several[np.argsort(of[several], kind="stable")], [0]
    for i in (np.flatnonzero(np.diff(of[order])) + 1).tolist():
        if i - cuts[-1] >= array_pieces:
            cuts.append(i)
    shown: list[list[tuple[int, int]]] = [[]] * len(text)
    for a, b in zip(cuts, [*cuts[1:], len(order)]):  # whole seeds in small arrays, which stay in the processor's cache
        part = order[a:b]
        if not len(part):
            break
        for i, runs in zip(part.tolist(), earlier_strings([text[i] for i in part], least[part], length)):
            shown[i] = runs
    out: dict[int, list[tuple[int, int]]] = {}
    for (p, a, n), r, late in zip(places, which.tolist(), (first[piece] > least[which]).tolist()):
        runs = [(0, n)] if late else shown[r]
        if runs:
            out.setdefault(p, []).extend((a + x, a + y) for x, y in runs)
    return out


def runs_in_pieces(apart: DataFrame, length: int, hot: int, bucket_pieces: int, array_pieces: int, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """``seed, ph, runs``: the runs of strings of each of the pieces of ``apart`` (``seed, ph, first, pieces, piece``) that another piece of its seed with a smaller ``first`` has as well.

    Suffix arrays show them, in buckets of whole seeds (see :func:`runs_in_bucket`). The pieces of a seed
    with over ``hot`` of them, as one at the edge of a passage that very many documents share, are cut
    anew by seeds twice as long, up to the whole string, of which a seed has one only; so no task needs
    all pieces of such a seed. ``apart`` is discarded.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, ph = pdf.seed.to_numpy(), pdf.ph.to_numpy()
        found = runs_in_bucket(seed, pdf["first"].to_numpy(), list(pdf.piece), length, array_pieces)
        kept = list(found)
        return pd.DataFrame({"seed": seed[kept], "ph": ph[kept], "runs": [[{"a": a, "b": b} for a, b in x] for x in found.values()]})

    cool, hotter = apart.where(F.col("pieces") <= hot), apart.where(F.col("pieces") > hot)
    buckets = cool.count() // bucket_pieces + 1
    found = cool.select("seed", "ph", "piece", "first", F.pmod(F.xxhash64("seed"), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInPandas(compare, "seed long, ph long, runs array<struct<a:int,b:int>>")
    if seed_bytes >= length or hotter.isEmpty():
        found = written(found, "runs")
        discard(apart)
        return found
    longer = min(2 * seed_bytes, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for seed, ph, piece, first in zip(*(c.to_pylist() for c in part.columns)):
                    rows += [(seed, ph, first, s, piece[a : a + n + length - 1], a, n) for s, a, n in zip(*(x.tolist() for x in pieces(piece, length, longer)))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()))], ["of", "of_ph", "own", "seed", "piece", "at", "n"])

    parts = written(hotter.select("seed", "ph", "piece", "first").mapInArrow(cut, "of long, of_ph long, own long, seed long, piece binary, at int, n int").withColumn("ph", F.xxhash64("piece")), "parts", "zstd")
    smaller = written(parts.groupBy("seed", "ph", "piece").agg(F.min("own").alias("first")), "smaller", "zstd")
    many = smaller.groupBy("seed").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1")
    rest = written(smaller.join(many, "seed"), "apart", "zstd")
    within = smaller.select("seed", "ph", "first").join(runs_in_pieces(rest, length, hot, bucket_pieces, array_pieces, longer), ["seed", "ph"], "left")
    runs = F.when(F.col("own") > F.col("first"), F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))).otherwise(F.col("runs"))
    each = parts.drop("piece").join(written(within, "within"), ["seed", "ph"]).select("of", "of_ph", "at", F.explode(runs).alias("r"))
    moved = F.struct((F.col("r.a") + F.col("at")).alias("a"), (F.col("r.b") + F.col("at")).alias("b"))
    out = written(found.unionByName(each.groupBy(F.col("of").alias("seed"), F.col("of_ph").alias("ph")).agg(F.collect_list(moved).alias("runs"))), "runs")
    discard(apart, parts, smaller)
    return out


def removed_ranges(own: DataFrame, length: int, hot: int = 4096, bucket_pieces: int = 4096, array_pieces: int = 64) -> DataFrame:
    """``id, th, start, n``: strings from ``start`` on, ``n`` of them, that stand in a document of a smaller id.

    Pieces of the same seed and hash are one: all their documents but the first lose all their strings.
    What different pieces of one seed have in common, their suffix arrays show (see :func:`runs_in_pieces`);
    only for these are bytes shuffled, once.
    """
    places = shared_pieces(own, length)
    least = F.min(F.struct("id", "th", "start", "n"))
    distinct = written(places.groupBy("seed", "ph").agg(least.alias("at"), F.max("id").alias("last")).select("seed", "ph", F.col("at.id").alias("first"), "at.th", "at.start", "at.n", "last"), "pieces", "zstd")
    runs = runs_in_pieces(pieces_apart(own, distinct, length), length, hot, bucket_pieces, array_pieces)
    marked = written(distinct.select("seed", "ph", "first", "last").join(runs, ["seed", "ph"], "left").where("first < last or runs is not null").drop("last"), "marked")
    discard(distinct, runs)
    named = places.select("seed", "ph", "id", "th", "start", "n").join(marked, ["seed", "ph"])
    all_of_it = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    gone = named.withColumn("runs", F.when(F.col("id") > F.col("first"), all_of_it).otherwise(F.col("runs"))).where("runs is not null")
    each = gone.select("id", "th", "start", F.explode("runs").alias("r"))
    out = written(each.select("id", "th", (F.col("start") + F.col("r.a")).alias("start"), (F.col("r.b") - F.col("r.a")).alias("n")), "ranges", "zstd")  # before the texts are shuffled
    discard(places, marked)
    return out


def drop_earlier_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` without the bytes that an earlier string covers.

    A string is ``length`` bytes of one document's UTF-8; it is earlier if it also starts in a document of
    a smaller id. Whole texts, judged on the input, overlaps count. ``kept`` (binary) is the remaining
    bytes joined, ``n_spans`` counts the maximal runs removed. A null text is empty; a null id is neither
    smaller nor larger than any, so its row takes and loses nothing; rows of the same id take nothing from
    each other; no rows give none; other columns are not read.
    """
    own = keyed(docs, id_col, text_col)
    ranges = ranges_by_document(removed_ranges(own.where("doc_id is not null"), length), "start", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw, spans = text.encode(), 0
                    kept = raw
                    if found:
                        edge = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(edge, [x["start"] for x in found], 1)
                        np.add.at(edge, [x["start"] + x["n"] + length - 1 for x in found], -1)
                        gone = np.cumsum(edge)[:-1] > 0
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = own.join(ranges, ["id", "th"], "left").select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("ranges")).alias("ranges"))
    return joined.mapInArrow(run, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
