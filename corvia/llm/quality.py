"""Quality classifier: a generalised additive model with pairwise interactions (Lou et al., "Accurate intelligible models", 2013)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digits", "marks", "symbols", "exclaims", "bars", "brackets", "beyond_ascii",
    "words_with_symbols", "words_all_upper", "adjacent_equal", "top_word", "distinct_words", "log_lines", "line_words", "repeated_lines", "entropy", "deflated", "short_words", "ends_marked",
)

_KIND = np.zeros(256, np.int64)  # of bytes: 1 upper, 2 lower, 3 digit, 4 sentence mark, 5 symbol, 6 bracket, 7 white space, 8 beyond ASCII
for _kind, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"-", b"#$%&*@^_~`+=|\\/!", b"()[]{}<>", b" \t\n\v\f\r"), 1):
    _KIND[list(_chars)] = _kind
_KIND[128:] = 8
_SYMBOLS = bytes(i for i in range(256) if _KIND[i] in (5, 6))


def features(text: str | None) -> np.ndarray:
    """The features of one whole text; all are finite, for empty texts too."""
    raw = (text or "").encode()
    out = np.zeros(len(FEATURES))
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=9)
    letters, n = max(1.0, kinds[1] + kinds[2] + kinds[8]), float(len(raw))
    words = raw.split()
    m = max(1, len(words))
    tally = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = raw.split(b"\n")
    share = counts[counts > 0] / n
    symbols = sum(c for w, c in tally.items() if w.translate(None, _SYMBOLS) != w)
    upper = sum(c for w, c in tally.items() if len(w) > 1 and w.isupper())
    out[:] = (
        np.log1p(n), np.log1p(len(words)), lengths.mean() if len(words) else 0, (lengths > 14).mean() if len(words) else 0, kinds[1] / letters, kinds[3] / n, kinds[4] / n, kinds[5] / n,
        counts[33] / n, counts[124] / n, kinds[6] / n, kinds[8] / n, symbols / m, upper / m, sum(map(bytes.__eq__, words, words[1:])) / m, max(tally.values(), default=0) / m, len(tally) / m,
        np.log1p(len(lines)), len(words) / len(lines), 1 - len(set(lines)) / len(lines), -(share * np.log2(share)).sum(), len(zlib.compress(raw, 1)) / n, (lengths < 4).mean() if len(words) else 0,
        sum(c for w, c in tally.items() if w[-1] in b".,;:?!") / m,
    )
    return out


def _steps(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The values of a tree of up to ``leaves`` leaves over ordered bins with gradients ``g`` and weights ``h``."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gl, hl, gr, hr = cg[k] - cg[a], ch[k] - ch[a], cg[b] - cg[k], ch[b] - ch[k]
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), int(k[i])))
        if not best[1]:
            break
        cuts = sorted({*cuts, best[1]})
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of the tree that cuts the rows of a two-dimensional table once and the columns once on either side."""
    top_g, top_h = np.cumsum(g, 0)[:-1], np.cumsum(h, 0)[:-1]
    gain, where = 0.0, []
    for part_g, part_h in ((top_g, top_h), (g.sum(0) - top_g, h.sum(0) - top_h)):
        lg, lh = np.cumsum(part_g, 1)[:, :-1], np.cumsum(part_h, 1)[:, :-1]
        ag, ah = part_g.sum(1, keepdims=True), part_h.sum(1, keepdims=True)
        each = lg**2 / (lh + ridge) + (ag - lg) ** 2 / (ah - lh + ridge)
        where.append(each.argmax(1))
        gain = gain + each.max(1)
    i = int(np.argmax(gain))
    out = np.zeros_like(g)
    for rows, j in ((slice(0, i + 1), where[0][i]), (slice(i + 1, None), where[1][i])):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[i] - g.sum() ** 2 / (h.sum() + ridge)), out


@dataclass
class Gam:
    """Lookup tables per feature and per pair of features; a score is the logistic of the sum of a row's entries."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def binned(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Vectorised bin additions."""
        total = np.full(len(x), self.intercept)
        for table, b in zip(self.tables, self.binned(x, self.edges)):
            total += table[b]
        if self.pairs:
            c = self.binned(x, self.coarse)
            for (i, j), table in self.pairs.items():
                total += table[c[i], c[j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 10, rounds: int = 160, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.15, leaves: int = 3, ridge: float = 2.0) -> Gam:
    """Cyclic boosting: in each round every feature in turn gets one shallow tree over its bins, then so do the best pairs.

    Pairs are ranked by the gain of one four-leaf tree on what the single features leave. No rows, or rows
    of one class only, give constant tables.
    """
    cut = lambda n: [np.unique(np.quantile(x[:, k], np.arange(1, n) / n)) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    model = Gam(cut(bins), coarse=cut(pair_bins))
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(rate_1 / (1 - rate_1)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y):
        return model
    fine, coarse = model.binned(x, model.edges), model.binned(x, model.coarse)
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _steps(np.bincount(fine[k], g, len(table)), np.bincount(fine[k], h, len(table)), leaves, ridge)
            table += step
            total += step[fine[k]]

    def table_of(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], v, shape[0] * shape[1]).reshape(shape)

    usable = [k for k, e in enumerate(model.coarse) if len(e)]
    g, h = slopes()
    ranked = sorted(((_quadrants(table_of(i, j, g), table_of(i, j, h), ridge)[0], i, j) for i, j in combinations(usable, 2)), reverse=True)
    model.pairs = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for _, i, j in ranked[:n_pairs]}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = slopes()
            step = rate * _quadrants(table_of(i, j, g), table_of(i, j, h), ridge)[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 40_000) -> Gam:
    """Fit on the labelled rows that are not held out, on the ``max_rows`` of them with the smallest hash of their id if there are more.

    The bound keeps what reaches the driver under ``max_rows`` rows of features; a model of this size gains
    nothing from more rows. Labels other than 0 and 1, and labels of unknown documents, are left out.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text").mapInArrow(run, "y int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows come in
    return fit_gam(x[order], y[order])


def score_quality(docs: DataFrame, model: Gam, text_col: str = "text") -> DataFrame:
    """``docs`` and ``score`` (double, 0 to 1) from the whole text of each row; null and empty texts are scored by their zero features."""
    docs = docs.drop("score")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 40_000) -> DataFrame:
    """``docs`` and ``score`` (double), ``predicted`` (int, 1 from a score of 0.5), ``held_out`` (boolean).

    Every row is returned; only the text enters its score. A null text scores as an empty one; a null id is
    not held out; repeated rows score alike; with no usable label all scores are 0.5; no rows give none.
    Columns of ``docs`` with the new names are replaced.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, max_rows)
    return score_quality(docs, model, text_col).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("held_out", held_out(F.col(id_col)))
