"""The operators against brute force, on random rows with nulls, empties, long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvia.llm.cosine import cosine_near_dup
from corvia.llm.debruijn import drop_repeated_spans
from corvia.llm.html import extract_pages, main_text
from corvia.llm.lines import drop_recurring_lines
from corvia.llm.mixing import mix_sources
from corvia.llm.packing import CapacityTree, best_fit_decreasing, best_fit_pack
from corvia.llm.quality import classify_quality, fit_gam
from corvia.llm.simhash import simhash_near_dup
from corvia.llm.suffixes import drop_earlier_strings, suffix_order
from corvia.llm.topk import top_k
from tests.llm import brute

CLASH = ("id", "th", "ranges", "seed", "fp", "start", "n", "node", "component", "_id", "_drops", "_n", "piece", "task", "kept")


def texts(seed: int = 1) -> list[tuple]:
    """Rows ``(doc_id, text)`` with shared passages, near copies and every edge case."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "delta9", "straße", "日本", "x", "the", "of", "river"]) + str(rng.randrange(60))
    shared = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(4)]
    rows: list[tuple] = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 50)))]
        for s in shared:
            if rng.random() < 0.4:
                parts.insert(rng.randrange(len(parts) + 1), s)
        rows.append((i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(parts)))
    long = " ".join(word() for _ in range(4000))
    near = rows[0][1].split(" ")
    near[len(near) // 2] = "changed"
    rows += [(200, long), (201, long + " tail"), (202, rows[0][1]), (203, " ".join(near)), (204, None), (205, ""), (206, " \n\t"), (207, "one"), (208, "ONE"), (209, "ab " * 300), (210, "a" * 400)]
    rows += [(202, rows[0][1]), (202, rows[0][1]), (203, "another text of a repeated id"), (None, rows[1][1]), (None, None)]
    return rows


def table(spark, rows, columns="doc_id long, text string"):
    df = spark.createDataFrame(rows, columns)
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns})


def test_simhash(spark):
    rows = texts()
    found = [tuple(r) for r in simhash_near_dup(table(spark, rows)).select("doc_id", "fp", "component_id").collect()]
    want = brute.simhash_components(rows)
    assert sorted(map(repr, found)) == sorted(repr((i, int(np.uint64(brute.fingerprint(t, 4)).astype(np.int64)), want.get(i))) for i, t in rows)
    assert simhash_near_dup(table(spark, [])).count() == 0


def test_simhash_links_at_the_edge(spark):
    """Fingerprints at 4 and 5 bits, compared through the class links alone."""
    from corvia.llm.simhash import linked_classes

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (0, 1, 3, 4, 5, 6, 9) for _ in range(3)}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    classes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    for bits in (4, 10):
        links = {(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if i < j and (a ^ b).bit_count() <= bits}
        ids = list(range(len(prints)))
        for many in (10**9, 0):  # either layout of the codes
            edges = linked_classes(classes, bits, unit=8, bucket_rows=64, many=many).collect()
            assert brute.reachable(ids, {(e.src, e.dst) for e in edges}) == brute.reachable(ids, links)


@pytest.mark.parametrize("window", [5, 35])
def test_repeated_spans(spark, window):
    rows = texts(2)
    found = drop_repeated_spans(table(spark, rows), window=window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in found) == sorted(map(repr, brute.repeated_words(rows, window)))
    assert drop_repeated_spans(table(spark, []), window=window).count() == 0


@pytest.mark.parametrize("hot", [4096, 2])
def test_earlier_strings(spark, monkeypatch, hot):
    import corvia.llm.suffixes as suffixes

    each = suffixes.removed_ranges
    monkeypatch.setattr(suffixes, "removed_ranges", lambda own, length: each(own, length, hot=hot, bucket_pieces=32))
    rows = texts(3)
    found = drop_earlier_strings(table(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(repr(tuple(r)) for r in found) == sorted(map(repr, brute.earlier_bytes(rows, 50)))
    assert drop_earlier_strings(table(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_order(text):
    assert suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def vectors(seed: int = 5) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 1.0])).tolist()) for i in range(150)]
    inf, nan = float("inf"), float("nan")
    rows += [(150, None), (151, [0.0] * 16), (152, [nan] * 16), (153, [inf] + [1.0] * 15), (154, [None] + [1.0] * 15), (155, [])]
    return rows + [(200 + i, rows[3][1]) for i in range(20)] + [(300, rows[5][1]), (301, (np.array(rows[5][1]) * 3).tolist()), (302, rows[0][1][:8])]


@pytest.mark.parametrize("unit", [1 << 21, 128])
def test_cosine(spark, monkeypatch, unit):
    import corvia.llm.cosine as cosine

    each = cosine.linked_vectors
    monkeypatch.setattr(cosine, "linked_vectors", lambda classes, dims, threshold: each(classes, dims, threshold, unit=unit))
    rows = [*vectors(), (None, vectors()[0][1]), (7, vectors()[9][1])]
    found = cosine_near_dup(table(spark, rows, "vec_id long, embedding array<double>")).collect()
    want = brute.cosine_links(rows, 0.95)
    assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in found) == sorted(map(repr, want))
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)
    assert cosine_near_dup(table(spark, [], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("cells", [{}, {"pivots": 4, "cell_rows": 16, "query_rows": 3}])
def test_top_k(spark, cells):
    rows = [x for x in vectors() if x[1] is None or len(x[1]) == 16] + [(None, vectors()[0][1])]
    df = table(spark, rows, "vec_id long, embedding array<double>")
    found = top_k(df, df.where("vec_id % 10 = 0"), k=5, scale=256, **cells).collect()
    assert {tuple(r) for r in found} == brute.best_products(rows, 10, 5, 256)
    assert len(found) == len(set(found))
    few = table(spark, rows[:3], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in top_k(few, few, k=5).collect()} == brute.best_products(rows[:3], 1, 5, 256)
    none = table(spark, [], "vec_id long, embedding array<double>")
    assert top_k(none, none).count() == 0


def test_packing_round_trip(spark):
    rows = texts(6)
    found = best_fit_pack(table(spark, rows), capacity=128).collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = [(i, [*tokens.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    want = []
    for i, ids in left:
        first = len(ids) % 128 or 128
        for k, start in enumerate([0, *range(first, len(ids), 128)]):
            part = ids[start : first if k == 0 else start + 128]
            want.append((i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(repr(tuple(r)[:5]) for r in found) == sorted(map(repr, want))
    bins: dict[int, list] = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    assert sorted(128 - sum(n for _, n in x) for x in bins.values()) == brute.bins_of_best_fit([x[3] for x in want], 128)
    assert best_fit_pack(table(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_decreasing(lengths):
    runs = best_fit_decreasing({n: lengths.count(n) for n in set(lengths)}, 20)
    left: dict[int, int] = {}
    for length, _, items, first, _ in runs:
        for b in range(first, first + items):
            left[b] = left.get(b, 20) - length
    assert sorted(left.values()) == brute.bins_of_best_fit(lengths, 20)


@given(st.dictionaries(st.integers(0, 30), st.integers(1, 3)), st.integers(0, 30))
def test_capacity_tree(held, need):
    tree = CapacityTree(30)
    for k, n in held.items():
        tree.set(k, n)
    assert tree.tightest(need) == min((k for k in held if k >= need), default=None)


def test_lines(spark):
    line = "page {} of the annual report by the office"
    rows = [(i, f"own words {chr(97 + i) * 3} alone\n{line.format(i)}\nshort line") for i in range(6)]
    rows += [(10, None), (11, ""), (None, line.format(9)), (12, "nothing here recurs anywhere in these texts at all")]
    found = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in drop_recurring_lines(table(spark, rows)).collect()}
    assert found[(0, rows[0][1])] == (3, 0)  # the first keeps its line
    assert all(found[(i, f"own words {chr(97 + i) * 3} alone\nshort line")] == (3, 1) for i in range(1, 6))
    assert found[(10, None)] == (0, 0) and found[(11, "")] == (1, 0) and found[(12, rows[-1][1])] == (1, 0) and found[(None, line.format(9))] == (1, 0)
    assert drop_recurring_lines(table(spark, [])).count() == 0


def test_mixing(spark):
    rows = [(i, "x" * (1 + i % 50), "big" if i % 10 else "small") for i in range(4000)] + [(5000, None, None), (None, "text", "small")]
    df = table(spark, rows, "doc_id long, text string, source string")
    found = mix_sources(df, weights={"big": 0.5, "small": 0.5})
    have = {r.source: r.n for r in found.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert abs(have["big"] / sum(have.values()) - 0.5) < 0.1 and None not in have
    assert found.columns[-2:] == ["copy", "shuffle_key"] and set(df.columns) <= set(found.columns)
    again = mix_sources(df, weights={"big": 0.5, "small": 0.5})
    assert sorted(map(repr, found.select("doc_id", "copy", "shuffle_key").collect())) == sorted(map(repr, again.select("doc_id", "copy", "shuffle_key").collect()))
    assert mix_sources(table(spark, [], "doc_id long, text string, source string")).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><header>Site head</header>
<div id=content><h1>The river &amp; the town</h1><p>A first paragraph, long enough to count, with some commas, and <b>bold</b> text.</p>
<p>A second paragraph, also long enough to be scored by its length and commas.<p>An unclosed one, which ends where the next block starts.</div>
<div class="sidebar"><p>Other stories, many of them, that are not the article, at all.</p></div><div class=comments><p>A reader says, loudly, that this is wrong.</p></div>
<form><input>Sign up</form><footer>Footer words</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_html(spark):
    want = "The river & the town A first paragraph, long enough to count, with some commas, and bold text. A second paragraph, also long enough to be scored by its length and commas. An unclosed one, which ends where the next block starts."
    assert main_text(PAGE) == want
    odd = ["", "<", "<p", "<<<>>>", "plain words without any markup at all", "<div>" * 3000 + "deep" + "</div>" * 3000, "<p>a &#x41; &nosuch; b</p>", "</p></div>", "<!-- open", "<p>" + "word, " * 20000]
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), *((10 + i, "w", x) for i, x in enumerate(odd))]
    found = extract_pages(table(spark, rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert [r.text for r in found if r.page_id == 1] == [want, want]
    assert extract_pages(table(spark, [], "page_id long, url string, html string")).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = classify_quality(docs.withColumn("score", F.lit("x")), labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = found.score[found.quality == 1], found.score[found.quality == 0]
    area = np.mean([np.mean(g > bad) + np.mean(g == bad) / 2 for g in good])
    assert (found.predicted == found.quality).mean() >= 0.85 and area >= 0.9, (area, len(found))


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "words " * 50000), (None, "a text"), (3, "words"), (4, "\u0000퟿ end")]
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (99, 1), (2, 5)], "doc_id long, quality int")
    found = classify_quality(table(spark, rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    none = classify_quality(table(spark, rows), labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert classify_quality(table(spark, []), labels).count() == 0


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = fit_gam(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9


def test_packing_knows_the_added_token(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "a <|endoftext| b"), (4, "x\n<|endoftext|>'s")]
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows for ids in [[*tokens.encode(t, add_special_tokens=False).ids, 0]]}
    assert {(r.doc_id, r.length, r.ids_crc32) for r in best_fit_pack(table(spark, rows)).collect()} == want


def test_mixing_repeats_small_sources_as_often_as_it_takes(spark):
    rows = [(i, "x" * 100, "big") for i in range(4000)] + [(5000 + i, "x" * 10, "small") for i in range(50)]
    df = table(spark, rows, "doc_id long, text string, source string")
    have = {r.source: r.n for r in mix_sources(df, weights={"big": 0.9, "small": 0.1}).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    want = 400_500 * 0.1  # a mean of 80 for each of the small source's documents
    assert abs(have["small"] / want - 1) < 0.1 and abs(have["big"] / (9 * want) - 1) < 0.1


def test_pipeline_drops_short_lines_that_recur(spark):
    import corpus_pipeline

    rows = [(i, f"own words {chr(97 + i) * 3} alone\nAll rights reserved.\n\n{i}\nPage {i}\n 7  up", "en", "a", 1) for i in range(4)] + [(9, "rare line\n", "en", "a", 1), (10, "rare line", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert found == {r[0]: r[1] if r[0] in (0, 9, 10) else f"own words {chr(97 + r[0]) * 3} alone\n\n{r[0]}\nPage {r[0]}" for r in rows}
