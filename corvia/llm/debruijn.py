"""Substring dedup by de Bruijn compaction of repeated token k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvia.llm.common import discard, keyed, ranges_by_document, written

#: Words that are hashed together to choose the piece a k-mer belongs to, and the most k-mers in a piece.
SEED_WORDS, MOST_EDGES = 8, 512
#: Texts that are taken apart together, and bytes of a word, with its space, up to which the polynomial is used.
BLOCK, LONG_WORD = 128, 256
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A value for each byte of a word, none for white space.
_BYTES = np.array([0 if _SPACE[x] else xxhash.xxh64_intdigest(bytes([x])) for x in range(256)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(data, first, bounds)``: the bytes of all words of ``texts``, one space after each; where each word starts in them; and the first word of each text. The latter two end with the end."""
    texts = texts.cast(pa.large_string())
    _, offsets, raw = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(raw or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid = ~_SPACE[raw]
    opens, ends = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    opens[edge] = solid[edge]
    ends[edge - 1] = solid[edge - 1]
    opens = np.flatnonzero(opens)
    first = np.concatenate(([0], np.cumsum(np.flatnonzero(ends) - opens + 2)))
    data, inside = np.full(first[-1], 0x20, np.uint8), np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    data[inside] = raw[solid]
    return data, first, np.searchsorted(opens, offsets)


def word_hashes(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each word of :func:`words_of`: a polynomial in the values of its bytes; for long words, where such polynomials are weak, XXH64."""
    size = np.diff(first)
    out, short = np.zeros(len(size), np.uint64), size <= LONG_WORD
    if not short.all():
        out[~short] = [xxhash.xxh64_intdigest(data[a : b - 1]) for a, b in zip(first[:-1][~short].tolist(), first[1:][~short].tolist())]
        out[short] = word_hashes(data[np.repeat(short, size)], np.concatenate(([0], np.cumsum(size[short]))))
        return out
    for at in range(0, len(out), 1 << 15):
        edge = first[at : at + (1 << 15) + 1] - first[at]
        values = _BYTES[data[first[at] : first[at] + edge[-1]]] * _powers(_FACTOR, edge[-1])
        out[at : at + len(edge) - 1] = np.add.reduceat(values, edge[:-1]) * _powers(_INVERSE, edge[-1])[edge[:-1]]
    return _mixed(out)


def run_hashes(each: np.ndarray, k: int) -> np.ndarray:
    """The 64-bit hash of each run of ``k`` words, from the words' hashes: those of runs of powers of two, by doubling, put together."""
    if len(each) < k:
        return np.zeros(0, np.uint64)
    run, width, factor, total, done = each, 1, int(_FACTOR), None, 0
    while True:
        if k & width:
            left = len(each) - done - width + 1
            total = run if total is None else total[:left] * np.uint64(factor) + run[done : done + left]
            done += width
        if done == k:
            break
        run = run[:-width] * np.uint64(factor) + run[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    total = total ^ total >> np.uint64(31)
    return total * np.uint64(0xBF58476D1CE4E5B9)


def pieces(each: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """``(seed, start, edges, ph, again)`` of texts that begin at the words ``bounds``: neighbouring k-mers of a text with the same least hash of ``SEED_WORDS`` words in them, so that equal k-mers have the same seed wherever they stand; the hash of the piece's k-mers, and whether it holds one twice."""
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(each))
    at = np.flatnonzero(left >= k)
    if not len(at):
        return *(np.zeros(0, np.int64),) * 4, np.zeros(0, bool)
    m = min(SEED_WORDS, k)
    least, width, span = run_hashes(each, m), 1, k - m + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    least, edges, order = least[at], run_hashes(each, k)[at], np.arange(len(at))
    opens = np.zeros(len(each) + 1, bool)
    opens[bounds] = True
    cut = np.concatenate(([True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | opens[at[1:]]))
    cut |= (order - np.maximum.accumulate(np.where(cut, order, 0))) % MOST_EDGES == 0
    starts = np.flatnonzero(cut)
    n = np.diff(np.concatenate((starts, [len(at)])))
    own = np.repeat(np.arange(len(starts)), n)
    ph = _mixed(np.add.reduceat(edges * _powers(_FACTOR, MOST_EDGES)[order - starts[own]], starts))
    keys = edges ^ _mixed(own.astype(np.uint64))
    ranked, again = np.sort(keys), np.zeros(len(starts), bool)
    again[own[np.isin(keys, ranked[1:][ranked[1:] == ranked[:-1]])]] = True
    return least[starts].view(np.int64), at[starts], n, ph.view(np.int64), again


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _ranges(column: pa.Array) -> tuple[np.ndarray, ...]:
    """The text each struct of the lists in ``column`` belongs to, and the structs' fields."""
    own = np.repeat(np.arange(len(column)), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    return own, *(x.to_numpy() for x in column.flatten().flatten())


def repeated_pieces(docs: DataFrame, k: int) -> DataFrame:
    """``seed, ph, id, th, start, n, again``: the pieces whose seed stands at two places or more, or that hold a k-mer twice; no other k-mer can be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            data, first, bounds = words_of(part.column(2))
            seed, start, n, ph, again = pieces(word_hashes(data, first), bounds, k)
            own = np.searchsorted(bounds, start, side="right") - 1
            rows = pa.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(ph), part.column(0).take(rows), part.column(1).take(rows), pa.array((start - bounds[own]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)], ["seed", "ph", "id", "th", "start", "n", "again"])

    each = written(docs.select("id", "th", "text").mapInArrow(run, "seed long, ph long, id long, th long, start int, n int, again boolean"), "each")
    often = written(each.groupBy("seed").agg(F.sum(F.lit(1) + F.col("again").cast("int")).alias("places")).where("places > 1").select("seed"), "often")
    places = written(each.join(often, "seed", "left_semi"), "places")
    discard(each, often)
    return places


def piece_edges(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """``seed, ph, m, edges``: the hashes of the k-mers, 8 bytes each, of the pieces ``chosen``, read at the one place that each has there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            data, first, bounds = words_of(part.column(0))
            edges = run_hashes(word_hashes(data, first), k)
            own, seed, ph, m, start, n = _ranges(part.column(1))
            start = bounds[own] + start
            raw = [edges[a:b].tobytes() for a, b in zip(start.tolist(), (start + n).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(ph), pa.array(m), pa.array(raw, pa.binary())], ["seed", "ph", "m", "edges"])

    asked = ranges_by_document(chosen, "seed", "ph", "m", "start", "n")
    read = docs.join(asked, ["id", "th"]).select("text", "ranges").mapInArrow(run, "seed long, ph long, m long, edges binary")
    return read.dropDuplicates(["seed", "ph"])  # rows may repeat as a whole


def repeated_paths(docs: DataFrame, k: int) -> DataFrame:
    """``id, th, start, n, path``: where the compacted paths of repeated edges stand; ``n`` edges from edge ``start``, ``path`` the name of the path.

    Each k-mer is an edge of the graph, from its first k-1 words to its last. Equal pieces are one, with
    the number of their places; the edges of the pieces are counted by these, and edges of one place are
    none of the graph. Where every place of an edge has the same edge before and after it, the path goes
    on; where they differ, or a piece or its repeated part ends, it branches. So each place of a path has
    all of it, and its first edge names it. The one piece of a seed that has no other is such a path as a
    whole, named by its hash, so its edges need no degrees and are not read. In and out degrees are
    aggregates by edge, joined back to the edges of the pieces, and the paths of a piece to its places in
    the documents.
    """
    places = repeated_pieces(docs, k)
    at = [F.first(c).alias(c) for c in ("id", "th", "start", "n")]
    distinct = written(places.groupBy("seed", "ph").agg(F.count(F.lit(1)).alias("m"), *at), "pieces")
    alone = distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("pieces"), F.max("m").alias("places")).where("pieces = 1 and places > 1").select("seed")
    piece = ["seed", "ph"]
    simple = distinct.join(alone, "seed", "left_semi").select("seed", "ph", F.lit(0).alias("first"), "n", F.col("ph").alias("path"))
    several = written(piece_edges(docs, distinct.join(alone, "seed", "left_anti"), k), "several")

    def edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = part.column(2).to_pylist()
                n = np.array([len(x) // 8 for x in raw])
                own = pa.array(np.repeat(np.arange(len(n)), n))
                pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), part.column(3).take(own), pa.array(pos.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), np.int64))], ["seed", "ph", "m", "pos", "h"])

    edges = several.select("seed", "ph", "edges", "m").mapInArrow(edges_of, "seed long, ph long, m long, pos int, h long")
    often = written(edges.groupBy("h").agg(F.sum("m").alias("n")).where("n > 1").select("h"), "often")  # a table, so that the join below may split a frequent edge
    graph = written(edges.join(often, "h", "left_semi").select(*piece, "pos", "h"), "graph")
    order = Window.partitionBy(*piece).orderBy("pos")
    before = F.when(F.lag("pos").over(order) == F.col("pos") - 1, F.lag("h").over(order))
    after = F.when(F.lead("pos").over(order) == F.col("pos") + 1, F.lead("h").over(order))
    branches = lambda c: F.coalesce((F.min(c) != F.max(c)) | F.bool_or(F.col(c).isNull()), F.lit(True))
    degrees = written(graph.withColumns({"before": before, "after": after}).groupBy("h").agg(branches("before").alias("opens"), branches("after").alias("ends")), "degrees")
    starts = F.col("opens") | F.coalesce(F.lag("ends").over(order), F.lit(True)) | (F.coalesce(F.lag("pos").over(order), F.lit(-2)) != F.col("pos") - 1)
    runs = graph.join(degrees, "h").withColumn("opened", starts).withColumn("run", F.sum(F.col("opened").cast("int")).over(order))
    compacted = runs.groupBy(*piece, "run").agg(F.min("pos").alias("first"), F.count(F.lit(1)).cast("int").alias("n"), F.max(F.when(F.col("opened"), F.col("h"))).alias("path")).select(*piece, "first", "n", "path")
    found = written(compacted.unionByName(simple), "paths")
    discard(distinct, several, often, graph, degrees)
    return places.select(*piece, "id", "th", "start").join(found, piece).select("id", "th", (F.col("start") + F.col("first")).alias("start"), "n", "path")


def verified(docs: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """Those of ``paths`` whose words, read at their source coordinates, stand at two places or more.

    Words are compared by 128 bits of their SHA-256, first all places of a path at once; only where these
    differ, which takes hashes of k-mers that collide, place by place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            data, first, bounds = words_of(part.column(2))
            raw, rows = data.tobytes(), part.select([0, 1])
            own, start, n, path = _ranges(part.column(3))
            a = bounds[own] + start
            low, high = first[a], first[a + n + k - 1] - 1
            words = np.frombuffer(b"".join([hashlib.sha256(raw[x:y]).digest()[:16] for x, y in zip(low.tolist(), high.tolist())]), np.int64).reshape(-1, 2)
            own = pa.array(own)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(own), rows.column(1).take(own), pa.array(start), pa.array(n), pa.array(path), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], ["id", "th", "start", "n", "path", "w", "x"])

    spans = ranges_by_document(paths, "start", "n", "path")
    read = written(docs.join(spans, ["id", "th"]).select("id", "th", "text", "ranges").mapInArrow(run, "id long, th long, start int, n int, path long, w long, x long"), "spans")
    alike = (F.min("w") == F.max("w")) & (F.min("x") == F.max("x")) & (F.count(F.lit(1)) > 1)
    mixed = written(read.groupBy("path").agg(alike.alias("alike")).where("not alike").select("path"), "mixed")
    words = ["path", "w", "x"]
    apart = read.join(mixed, "path", "left_semi")
    same = apart.groupBy(*words).agg(F.count(F.lit(1)).alias("places")).where("places > 1").select(*words)
    return read.join(mixed, "path", "left_anti").unionByName(apart.join(same, words, "left_semi").select(read.columns)).select("id", "th", "start", "n")


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, kept`` without the words that a repeated window covers.

    A window is ``window`` consecutive words of one document, whole texts, words as they are; it is
    repeated if its words also start anywhere else, in the same document too. Windows are judged on the
    input. ``kept`` is the rest, words joined by one space. A null text has no words; a null id is
    returned as null; rows that repeat an id or all of a row are documents of their own; no rows give
    none; other columns are not read.
    """
    own = keyed(docs, id_col, text_col)
    spans = ranges_by_document(verified(own, repeated_paths(own, window), window), "start", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            data, first, bounds = words_of(part.column(1))
            doc, start, n = _ranges(part.column(2))
            steps, a = np.zeros(len(first), np.int64), bounds[doc] + start
            np.add.at(steps, a, 1)
            np.add.at(steps, a + n + window - 1, -1)
            left = np.cumsum(steps)[:-1] == 0
            count = np.concatenate(([0], np.cumsum(left)))[bounds]
            size = np.diff(first)
            stay = np.repeat(left, size)
            at, last = np.flatnonzero(left), count[1:][np.diff(count) > 0] - 1
            stay[first[at[last] + 1] - 1] = False  # no space after a text's last word
            lengths = np.where(left, size, 0)
            lengths[at[last]] -= 1
            ends = np.concatenate(([0], np.cumsum(lengths)))[bounds]
            raw = data[stay].tobytes()
            texts = [raw[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(np.diff(bounds) - np.diff(count)), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), kept], [id_col, "n_words", "n_removed", "kept_sha256", "kept"])

    joined = own.join(spans, ["id", "th"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(run, f"{id_col} long, n_words long, n_removed long, kept_sha256 string, kept string")
