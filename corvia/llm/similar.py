"""Near-duplicates by the Jaccard similarity of word shingles: SimHash links first, then what fingerprints miss by prefix filtering (Chaudhuri et al., 2006; Bayardo et al., 2007)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import discard, pair_units, written
from corvia.llm.graph import components
from corvia.llm.simhash import forest, linked_classes, majority, shingle_hashes

#: One document in so many is read for the shingles that are common, of which so many are kept: they only order prefixes, and any order gives the same links.
SAMPLE, COMMON = 16, 65536
#: Where over so many nodes share a shingle, they are compared with two of them first; the parts that sets are counted in.
HUB, PARTS = 8, 256


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The different shingles' hashes (signed), ascending; a text without words has one, that of the empty string."""
    return np.unique((hashes if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)).view(np.int64))


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample of ``texts`` (``id, text``), ascending, and in how many of its documents each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(shingle_hashes(text, shingle)))], ["shingle"])

    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "shingle long")
    top = sample.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    rows = np.array(sorted((r.shingle, r.n) for r in top), np.int64).reshape(-1, 2)
    return rows[:, 0], rows[:, 1]


def sketches(texts: DataFrame, shingle: int, min_similarity: float) -> DataFrame:
    """``id, same, n, fp, prefix``: a key of the set of shingles, its size, the SimHash, and so many of the set's rarest that two similar sets share one of them."""
    common, counts = common_shingles(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, sizes, prints, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, shingle)
                found = shingle_set(hashes)
                often = np.zeros(len(found), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    often = np.where(common[at] == found, counts[at], 0)
                most = len(found) - math.ceil(min_similarity * len(found) - 1e-9) + 1
                same.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                prints.append(majority(hashes))
                lists.append(found[np.lexsort((found, often))[:most]])
            columns = [batch.column(0), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "same", "n", "fp", "prefix"])

    return texts.mapInArrow(run, "id long, same binary, n long, fp long, prefix array<long>")


def shingle_sets(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``node, n, parts, found`` of the documents in ``nodes``: the set of shingles, its size, and how many of it have each of the ``PARTS`` lowest bits' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(shingle_hashes(t, shingle)) for t in part.column(1).to_pylist()]
                parts = [np.bincount(x & (PARTS - 1), minlength=PARTS).astype(np.int32) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(parts, pa.list_(pa.int32())), pa.array(sets, pa.list_(pa.int64()))], ["node", "n", "parts", "found"])

    return texts.join(nodes, texts["id"] == nodes["node"]).select("node", "text").mapInArrow(run, "node long, n long, parts array<int>, found array<long>")


def similar_pairs(sets: DataFrame, pairs: DataFrame, min_similarity: float) -> DataFrame:
    """Those of ``pairs`` (``src, dst``: nodes) whose sets have a Jaccard similarity of ``min_similarity`` or more."""
    side = lambda column: (sets.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in column)) for end in ("src", "dst"))
    (a, b), (x, y) = side(("n", "parts")), side(("found",))
    enough = F.lit(min_similarity / (1 + min_similarity) - 1e-9) * (F.col("n_src") + F.col("n_dst"))
    most = F.aggregate(F.zip_with("parts_src", "parts_dst", lambda u, v: F.least(u, v)), F.lit(0), lambda s, v: s + v)  # what they can have in common at most, for a small part of what the sets take
    fit = F.least("n_src", "n_dst") >= F.greatest("n_src", "n_dst") * F.lit(min_similarity - 1e-9)
    maybe = written(pairs.join(a, "src").join(b, "dst").where(fit).where(most >= enough).select("src", "dst", "n_src", "n_dst"), "maybe")  # written, so that its size is known: few pairs go to the sets, not the sets to the pairs
    both = F.size(F.array_intersect("found_src", "found_dst"))
    joined = maybe.join(x, "src").join(maybe.select("src", "dst").join(y, "dst"), ["src", "dst"]).withColumn("both", both)
    return joined.where(F.col("both") >= F.lit(min_similarity) * (F.col("n_src") + F.col("n_dst") - F.col("both"))).select("src", "dst")


def similar_in_clusters(sets: DataFrame, clusters: DataFrame, min_similarity: float, unit: int) -> DataFrame:
    """Edges ``src, dst`` between those nodes of a cluster (``node, cluster, label``) that are similar and not connected yet.

    Every pair of a cluster meets in a unit of at most about twice ``unit`` shingles. Nodes of one label are
    connected already, and what a unit finds connected it does not compare again, so it returns under as
    many edges as it has nodes.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf.node.to_numpy(), pdf.n.to_numpy()))]
        node, n, chunk, lists = pdf.node.to_numpy(), pdf.n.to_numpy(), pdf.chunk.to_numpy(), list(pdf.found)
        label = np.unique(pdf.label.to_numpy(), return_inverse=True)[1]
        apart = pdf.lo.iloc[0] != pdf.hi.iloc[0]
        words, flat = np.unique(np.concatenate(lists), return_inverse=True)
        ends = np.cumsum(n)
        starts, mark, src, dst = ends - n, np.zeros(len(words), bool), [], []
        for i in range(len(node) - 1):
            last = int(np.searchsorted(n, n[i] / min_similarity + 1e-6, side="right"))
            open_ = (label[i + 1 : last] != label[i]) & ((chunk[i + 1 : last] != chunk[i]) if apart else True)
            if not open_.any():
                continue
            own = flat[starts[i] : ends[i]]
            mark[own] = True
            both = np.add.reduceat(mark[flat[starts[i + 1] : ends[last - 1]]], starts[i + 1 : last] - starts[i + 1], dtype=np.int64)
            mark[own] = False
            near = np.flatnonzero(open_ & (both >= min_similarity * (n[i + 1 : last] + n[i] - both))) + i + 1
            for j in near.tolist():
                if label[j] != label[i]:
                    src.append(node[i])
                    dst.append(node[j])
                    label[label == label[j]] = label[i]
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    rows = written(sets.drop("parts").join(clusters, "node"), "clusters")
    return pair_units(rows, ["cluster"], F.col("node"), unit, F.col("n")).groupBy("cluster", "lo", "hi").applyInPandas(compare, "src long, dst long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, min_similarity: float = 0.8, max_bits: int = 4, hot: int = 256, unit: int = 2_000_000, rounds: int = 1) -> DataFrame:
    """``node, component``: each id that some other is linked to, and the smallest id reachable.

    Two documents link if the Jaccard similarity of their sets of word shingles is ``min_similarity`` or
    more; every such pair counts and no other. Equal sets are one node. SimHash fingerprints within
    ``max_bits`` bits, found at the anchors of a covering code, are candidates whose sets decide; they
    connect most of a group of near copies. At a similarity of 0.8 fingerprints differ in about ten bits,
    so many pairs are beyond any code's reach; these come by prefixes: similar sets share one of the
    shingles of their prefixes, so nodes that do, are not connected yet and may have enough in common by
    the places of what they share (Xiao et al., 2008) are compared. Where over ``hot``
    nodes share a shingle, all that such shingles connect are a cluster, compared in units of chunk pairs.
    Texts of no words (null, too) link with each other; rows of one id are one node; rows without id are
    left out; no rows give none; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    own = written(sketches(texts, shingle, min_similarity), "sketches")
    classes = written(own.groupBy("same").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("prefix").alias("prefix")), "classes")
    equal = own.join(classes.select("same", "node"), "same").where("id <> node").select(F.col("node").alias("src"), F.col("id").alias("dst"))

    posted = classes.select("node", "n", F.posexplode("prefix").alias("at", "shingle"))
    keys = written(posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("shingle"), "keys")
    held = written(posted.join(keys, "shingle"), "posted")
    sets = written(shingle_sets(texts, held.select("node").distinct(), shingle), "sets")

    prints = classes.groupBy("fp").agg(F.min("node").alias("node"))
    alike = classes.join(prints.withColumnRenamed("node", "src"), "fp").where("src <> node").select("src", F.col("node").alias("dst"))
    close = linked_classes(written(prints, "prints"), max_bits).unionByName(alike)
    sure = written(similar_pairs(sets, close, min_similarity), "sure")
    for step in range(rounds + 1):
        known = written(components(sure).select("node", F.col("component").alias("label")), "known")
        labelled = written(held.join(known, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        hub = lambda label: F.min(F.struct(label, "node"))
        mixed = written(labelled.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"), hub("label").alias("low"), hub(-F.col("label")).alias("high")).where("low.label <> -high.col1"), "mixed")
        if step == rounds:
            break
        ends = F.explode(F.array(F.struct(F.col("low.node").alias("src"), F.col("low.label").alias("of")), F.struct(F.col("high.node").alias("src"), (-F.col("high.col1")).alias("of"))))
        hubs = written(mixed.where(F.col("sets") > HUB).select("shingle", ends.alias("hub")).select("shingle", "hub.*"), "hubs")
        around = written(labelled.join(hubs, "shingle").where("label <> of").select("src", F.col("node").alias("dst")).distinct(), "around")
        if around.isEmpty():
            break
        before, sure = sure, written(sure.unionByName(similar_pairs(sets, around, min_similarity)), "sure")
        discard(before, known, labelled, mixed, hubs, around)
    open_ = written(labelled.join(mixed.select("shingle", "sets", F.col("low.node").alias("first")), "shingle"), "open")
    joined = components(open_.where(F.col("sets") > hot).select("first", "node"), "first", "node")
    clusters = written(joined.select("node", F.col("component").alias("cluster")).join(known, "node", "left").withColumn("label", F.coalesce("label", "node")), "clusters")
    few = open_.where(F.col("sets") <= hot).join(clusters.select("node", "cluster"), "node", "left").select("shingle", "node", "n", "at", "label", "cluster")
    a, b = (few.select("shingle", *(F.col(c).alias(f"{c}_{end}") for c in ("node", "n", "at", "label", "cluster"))) for end in "ab")
    fit = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(min_similarity - 1e-9)
    apart = (F.col("label_a") != F.col("label_b")) & ~F.coalesce(F.col("cluster_a") == F.col("cluster_b"), F.lit(False))
    met = a.join(b, "shingle").where((F.col("node_a") < F.col("node_b")) & fit & apart)
    together = met.groupBy(F.col("node_a").alias("src"), F.col("node_b").alias("dst"), "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    most = F.col("shared") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1  # what they have in common up to the last place they share, and all that comes after
    enough = F.lit(min_similarity / (1 + min_similarity) - 1e-9) * (F.col("n_a") + F.col("n_b"))
    pairs = written(together.where(most >= enough).select("src", "dst"), "pairs")
    discard(labelled, mixed, open_, held, keys)
    found = written(sure.unionByName(similar_pairs(sets, pairs, min_similarity)).unionByName(similar_in_clusters(sets, clusters, min_similarity, unit)).unionByName(equal), "links")
    discard(own, classes, sets, sure, known, clusters, pairs)
    return components(found)
