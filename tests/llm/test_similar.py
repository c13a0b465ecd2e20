"""Near-duplicates of the pipeline against all pairs of 0.8 or more, with no gate before the similarity."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from corvia.llm.similar import similar_groups
from tests.conftest import SMALL
from tests.llm import brute


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def all_links(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    return {(min(a, b), max(a, b)) for a, x in sets for b, y in sets if a != b and len(x & y) >= 0.8 * len(x | y)}


def wanted(rows):
    label = brute.reachable([i for i, _ in rows if i is not None], all_links(rows))
    return {i for i, c in label.items() if i == c}


def test_pipeline_finds_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    far = {(a, b) for a, b in all_links(rows) if (brute.fingerprint(dict(rows)[a], 5) ^ brute.fingerprint(dict(rows)[b], 5)).bit_count() > 10}
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).select("doc_id").collect()}
    assert far and all(b not in left for _, b in far) and left == wanted(rows)


@pytest.mark.parametrize("hot, unit", [(32, 200_000), (2, 800), (1000, 200_000), (8, 800)])
def test_groups_of_varied_edits(spark, hot, unit):
    """Near copies of which about each second pair is under 0.8, some edge cases, and repeated ids."""
    rng, rows = random.Random(9), []
    for group in range(3):
        base = [f"w{rng.randrange(400)}" for _ in range(100)]
        for i in range(40):
            words = list(base)
            for at in rng.sample(range(100), rng.randrange(5)):
                words[at] = f"e{rng.randrange(10**6)}"
            rows.append((group * 100 + i, " ".join(words)))
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "one"), (504, "ONE"), (505, "ab " * 300), (506, "ab " * 20), (0, rows[50][1]), (None, rows[0][1])]
    found = {r.node: r.component for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, unit=unit).collect()}
    label = brute.reachable([i for i, _ in rows if i is not None], all_links(rows))
    assert {i: found.get(i, i) for i in label} == label
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_keeps_documents_under_the_similarity(spark):
    """A passage repeated often weighs in the fingerprint, not in the similarity."""
    passage = " ".join(f"p{i}" for i in range(40)) + " "
    rows = [(i, passage * 60 + " ".join(f"own{i}x{k}" for k in range(60)), "en", "a", 1) for i in range(3)]
    prints = [brute.fingerprint(r[1], 5) for r in rows]
    assert max((a ^ b).bit_count() for a in prints for b in prints) <= 4 and not all_links([r[:2] for r in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).select("doc_id").collect()} == {0, 1, 2}
