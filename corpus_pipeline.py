"""The training-data pipeline over ``documents``: filter by quality, drop recurring lines, drop near-duplicates, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.llm.common import read, written
from corvia.llm.lines import drop_recurring_lines
from corvia.llm.mixing import mix_sources
from corvia.llm.packing import best_fit_pack
from corvia.llm.quality import fit_quality, score_quality
from corvia.llm.similar import similar_groups


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on the labelled rows that are not held out, scores 0.5 or more."""
    model = fit_quality(docs, read(spark, sf_dir, "labels"), max_rows=40_000)
    return score_quality(docs, model).where("score >= 0.5").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs in three documents or more, lines of under five tokens as they stand; the first of these keeps its line."""
    kept = drop_recurring_lines(docs, min_docs=3, depth=3, min_tokens=5, min_constant=0.6, short_lines=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id, and the rows without id.

    Near-duplicates are linked by a Jaccard similarity of 0.8 or more on shingles of five words: by SimHash
    at the anchors of a covering code, checked on the shingles, and what fingerprints miss by prefixes.
    """
    gone = similar_groups(docs, shingle=5, min_similarity=0.8).where("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come to the square roots of their shares."""
    return mix_sources(docs, alpha=0.5, size=1.0, seed=42).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return best_fit_pack(docs, capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
