"""The registered queries: against DuckDB where SQL exists, against brute force where not, and the pipeline's stages."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvia.llm import queries
from tests.conftest import SMALL
from tests.llm import brute


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rounded = lambda row: repr(tuple(round(x, 9) if isinstance(x, float) else x for x in row))
    found = queries.QUERIES[name](spark, SMALL).select(columns).collect()
    assert sorted(map(rounded, found)) == sorted(map(rounded, want.fetchall()))


def test_op4(spark, documents):
    want = brute.simhash_components(documents)
    found = queries.op4_simhash_near_dup(spark, SMALL).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted((i, f"{brute.fingerprint(t, 4):016x}", want[i]) for i, t in documents)


def test_op6(spark, documents):
    assert sorted(map(tuple, queries.op6_debruijn_substring_dedup(spark, SMALL).collect())) == sorted(brute.repeated_words(documents, 35))


def test_op7(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = queries.op7_subspace_near_dup(spark, SMALL).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(brute.cosine_links(rows, 0.95))


def test_op10(spark, documents):
    assert sorted(map(tuple, queries.op10_suffix_grouping_dedup(spark, SMALL).collect())) == sorted(brute.earlier_bytes(documents, 50))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    quality, lines, near, mix = (f for _, f in corpus_pipeline.STAGES[:4])
    kept = quality(spark, docs, SMALL)
    assert kept.columns == docs.columns and 0.5 * docs.count() < kept.count() < docs.count()
    cleaned = lines(spark, docs, SMALL)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count() and cleaned.where(F.length("text") != F.col("n_chars")).count() == 0
    left = near(spark, docs, SMALL)
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = {i: set(zip(*[brute.WORDS(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))[k:] for k in range(5)])) or {tuple(brute.WORDS(t.lower()))} for i, t in rows}
    links = {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 0.8 * len(words[a] | words[b])}
    assert ids == {i for i, c in brute.reachable(list(words), links).items() if i == c}
    assert mix(spark, docs, SMALL).columns == docs.columns


def test_pipeline_runs(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 0


def test_rows_with_nulls_go_through_the_pipeline(spark, tmp_path):
    rows = [(1, "some words of a text that is plain enough to read, and long enough.", "en", "a", 10), (2, None, None, None, None), (None, "x y z", "en", "a", 5), (3, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
