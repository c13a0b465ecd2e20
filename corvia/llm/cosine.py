"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import pair_units, written
from corvia.llm.graph import components
from corvia.llm.simhash import forest
from corvia.llm.vectors import all_finite, matrix

#: Budgets of squared distance are widened by this much, far above rounding; the exact test decides.
SLACK = 1e-9
#: Coordinates of a block that are cut into cells: with each, a vector goes to half as many cells more.
GRID = 2


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]


def units_of(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square overflows or vanishes
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Subspaces:
    """Blocks of the rotated coordinates, each with its share of the squared distance that the threshold allows."""

    def __init__(self, dims: int, threshold: float, width: int):
        self.cuts = [x for x in np.array_split(np.arange(dims), max(1, dims // width)) if len(x)]
        self.turn = rotation(dims)
        self.budgets = [2 * (1 - threshold) * len(x) / dims + SLACK for x in self.cuts]

    def first_met(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first block in which each pair of rows keeps to its budget."""
        d = (a - b) ** 2
        return np.stack([d[:, x].sum(1) <= y for x, y in zip(self.cuts, self.budgets)], 1).argmax(1)


def linked_vectors(classes: DataFrame, dims: int, threshold: float, width: int = 8, unit: int = 1 << 21) -> DataFrame:
    """``node, root, links`` from each comparison: ``links`` sums the sizes of the classes linked to the node there, ``root`` is the smallest place of its component there.

    ``classes`` is ``node, size, v``, vectors all different. If two unit vectors are within the threshold's
    distance, in some block they are within that block's share of it. Each block is range-joined: its first
    ``GRID`` coordinates are cut into cells twice as wide as the block's reach. A vector goes to its own
    cell and, along each coordinate, to the lower one if its reach touches that; so two vectors meet in the
    cell that is along each coordinate the lower of theirs, and count there alone. The next coordinate
    bounds the partners, the block's squared distance (in single precision, with a margin) picks the
    candidates and the cosine of the whole vectors decides. A pair counts in the first block that it
    meets. A cell of over ``unit`` components is cut into chunk pairs.
    """
    spaces = Subspaces(dims, threshold, width)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                turned = units_of(matrix(part.column(2), dims)) @ spaces.turn
                for block, (cut, budget) in enumerate(zip(spaces.cuts, spaces.budgets)):
                    reach, row = np.sqrt(budget), np.arange(len(turned))
                    cell, home = np.zeros(len(row), np.int64), np.zeros(len(row), np.int32)
                    for i, along in enumerate(cut[:GRID]):
                        own, low = (np.floor(x / (2 * reach)).astype(np.int64) for x in (turned[row, along], turned[row, along] - reach))
                        touch = np.flatnonzero(low < own)
                        cell, home = cell << 21 | (own + (1 << 20)), home | 1 << i
                        row, cell, home = np.concatenate([row, row[touch]]), np.concatenate([cell, cell[touch] - 1]), np.concatenate([home, home[touch] ^ 1 << i])
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), block, np.int32)), pa.array(cell), pa.array(home), *(part.column(i).take(take) for i in range(3))], ["block", "cell", "home", "node", "size", "v"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        block, apart = int(pdf.block.iloc[0]), pdf.lo.iloc[0] != pdf.hi.iloc[0]
        v = matrix(list(pdf.v), dims)
        turned = units_of(v) @ spaces.turn
        cut, budget = spaces.cuts[block], spaces.budgets[block]
        along, everywhere = cut[min(GRID, len(cut) - 1)], (1 << len(cut[:GRID])) - 1
        order = np.argsort(turned[:, along], kind="stable")
        pdf, v, turned = pdf.iloc[order], v[order], turned[order]
        node, size, chunk, home = pdf.node.to_numpy(), pdf["size"].to_numpy(), pdf.chunk.to_numpy(), pdf.home.to_numpy()
        sorted_by, part, reach = turned[:, along], turned[:, cut], np.sqrt(budget)
        norms = (part * part).sum(1)
        left, right = np.column_stack([-2 * part, norms, np.ones(len(part))]).astype(np.float32), np.column_stack([part, np.ones(len(part)), norms]).T.astype(np.float32).copy()
        links, members, roots = np.zeros(len(node)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(node), 256):
            end = min(at + 256, len(node))
            last = int(np.searchsorted(sorted_by, sorted_by[end - 1] + reach, side="right"))
            r, c = np.divmod(np.flatnonzero((left[at:end] @ right[:, at:last] <= np.float32(budget + 1e-5)).ravel()), last - at)
            r, c = r + at, c + at
            keep = (c > r) & ((home[r] | home[c]) == everywhere) & ((chunk[r] != chunk[c]) if apart else True)
            r, c = r[keep], c[keep]
            for k in range(0, len(r), 65536):
                a, b = r[k : k + 65536], c[k : k + 65536]
                good = (spaces.first_met(turned[a], turned[b]) == block) & (cosines(v[a], v[b]) >= threshold)
                a, b = a[good], b[good]
                if len(a):
                    links += np.bincount(a, size[b], len(node)) + np.bincount(b, size[a], len(node))
                    members, roots = forest(np.concatenate([members, a]), np.concatenate([roots, b]), len(node))
        root = np.arange(len(node))
        root[members] = roots
        linked = np.flatnonzero(links)
        return pd.DataFrame({"node": node[linked], "root": node[root[linked]], "links": links[linked].astype(np.int64)})

    spread_out = classes.select("node", "size", "v").mapInArrow(spread, "block int, cell long, home int, node long, size long, v array<double>")
    rows = pair_units(spread_out, ["block", "cell"], F.col("node"), max(1, unit // dims))
    return rows.groupBy("block", "cell", "lo", "hi").applyInPandas(compare, "node long, root long, links long")


def cosine_near_dup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per row of ``rows``: ``vec_id, n_links, component_id, kept``.

    Rows link at a cosine of ``threshold`` or more, in double precision. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest id reachable, ``kept`` marks that row. Equal vectors
    are one class before any comparison, so copies cost no comparisons. Vectors that are null, empty, all
    zero or hold null or non-finite components link with nothing; shorter vectors end in zeros; a row
    without id has no links and a null component; repeated ids count as rows of their own; no rows give
    none; other columns are not read.
    """
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = all_finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    members = own.where(usable)
    classes = written(members.groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("size")).select("node", "size", "v"), "vectors")
    alone = own.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    dims = classes.agg(F.max(F.size("v"))).first()[0]
    if dims:
        found = written(linked_vectors(classes, dims, threshold), "links")
        named = components(found, "node", "root")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        of_class = classes.join(links, "node", "left").join(named, "node", "left").select("v", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
        alone = alone.unionByName(members.join(of_class, "v").select("id", "n_links", "component"))
    return alone.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
