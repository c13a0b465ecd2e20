"""Cases that single operators were once wrong on, and small brute-force versions of their inner parts."""

from __future__ import annotations

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corvia.llm import queries
from corvia.llm.common import keyed
from corvia.llm.debruijn import drop_repeated_spans, pieces, run_hashes, verified, word_hashes, words_of
from corvia.llm.html import PARAGRAPHS, _link_density, _scored, main_text, parse
from corvia.llm.lines import drop_recurring_lines
from corvia.llm.mixing import mix_sources
from corvia.llm.quality import _quadrants, _steps
from corvia.llm.suffixes import drop_earlier_strings, runs_in_bucket
from tests.conftest import SMALL
from tests.llm import brute


def test_many_equal_rows(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(1, words)] * 500 + [(2, words)] * 3 + [(3, words + " tail")] + [(None, words)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for operator, want in ((drop_repeated_spans, brute.repeated_words(rows, 35)), (drop_earlier_strings, brute.earlier_bytes(rows, 50))):
        began = time.perf_counter()
        found = [tuple(r) for r in operator(df).drop("kept").collect()]
        assert sorted(map(repr, found)) == sorted(map(repr, want))
        assert time.perf_counter() - began < 60


def test_null_ids_take_and_lose_nothing(spark):
    text = "a passage of some length, which stands in both of the rows, and in a third one too"
    rows = [(None, text), (-1, text), (5, text)]
    found = {r.doc_id: r.n_removed for r in drop_earlier_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {None: 0, -1: 0, 5: len(text)}


STORY = "".join(f"<p>Paragraph {i} of the story, long enough to count, with commas, and more words in it.</p>" for i in range(6))
TEXT = " ".join(f"Paragraph {i} of the story, long enough to count, with commas, and more words in it." for i in range(6))


@pytest.mark.parametrize("name", ["post tags-layout", "article-body comments-open", "story"])
def test_a_word_in_a_class_does_not_delete_a_story(name):
    assert main_text(f"<body><nav>menu</nav><div class='{name}'>{STORY}</div><footer>f</footer></body>") == TEXT


def test_furniture_goes():
    for box in ("<div class='comments'>%s</div>", "<div class='post-comments'>%s</div>", "<div id=sidebar>%s</div>", "<aside>%s</aside>", "<div role=navigation>%s</div>", "<div class='ad-slot'>%s</div>"):
        page = f"<body><div>{STORY}</div>{box % '<p>A reader says, loudly, that all of this is wrong.</p>'}</body>"
        assert main_text(page) == TEXT
        assert main_text(f"<body>{box % '<a href=x>only a link</a>'}</body>") == ""


def test_a_teaser_does_not_beat_the_story():
    teaser = "<article class=teaser><p>A teaser, short, about another story, which is long enough to count as one, and longer than it should be, by far.</p></article>"
    assert main_text(f"<body>{teaser}<div>{STORY}</div></body>") == TEXT


def test_deep_pages_are_whole_and_quick():
    n = 4000
    page = "".join(f"<div>text of level {i}, with a comma and words" for i in range(n)) + "</div>" * n
    began = time.perf_counter()
    assert main_text(page) == " ".join(f"text of level {i}, with a comma and words" for i in range(n))
    assert time.perf_counter() - began < 1


def test_scores_against_the_definition():
    """Points of each block's own line, passed on by halves, summed up anew for each element."""
    rng = random.Random(3)

    def build(depth: int) -> str:
        parts = [rng.choice(["some words, and more words of a line ", "short ", "<b>bold words</b> ", "<a href=x>a link with words</a> "]) for _ in range(rng.randrange(3))]
        if depth:
            parts += [f"<{t}>{build(depth - 1)}</{t}>" for t in rng.choices(["div", "p", "section", "ul"], k=rng.randrange(4))]
        rng.shuffle(parts)
        return "".join(parts)

    for _ in range(60):
        root = parse(f"<body>{build(4)}</body>")
        order = _scored(root)
        assert order == list(root.walk())
        score = dict.fromkeys(map(id, order), 0.0)
        for x in order:
            at, share = (x.parent, 1.0) if x.tag in PARAGRAPHS and x.parent else (x, 1.0)
            while at:
                score[id(at)] += x.points * share if x.tag not in PARAGRAPHS or at is not x else 0.0
                at, share = at.parent, share / 2
        for x in order:
            assert abs(x.score - score[id(x)]) < 1e-9
            strings = [t for y in x.walk() for t in y.kids if isinstance(t, str)]
            assert x.chars == sum(len(" ".join(t.split())) for t in strings)
            assert 0 <= _link_density(x) <= 1


def test_trees_against_all_cuts():
    rng = np.random.default_rng(2)
    for _ in range(40):
        g, h = rng.standard_normal(9), rng.random(9) + 0.1
        value = lambda a, b, g=g, h=h: g[a:b].sum() ** 2 / (h[a:b].sum() + 2.0)
        one = max(range(1, 9), key=lambda k: value(0, k) + value(k, 9))
        found = _steps(g, h, 2, 2.0)
        assert np.allclose(found, np.concatenate([np.full(one, g[:one].sum() / (h[:one].sum() + 2.0)), np.full(9 - one, g[one:].sum() / (h[one:].sum() + 2.0))]))
        g, h = rng.standard_normal((5, 4)), rng.random((5, 4)) + 0.1
        part = lambda r, c, g=g, h=h: g[r, c].sum() ** 2 / (h[r, c].sum() + 2.0)
        best = max(
            part(slice(0, i), slice(0, j)) + part(slice(0, i), slice(j, 4)) + part(slice(i, 5), slice(0, k)) + part(slice(i, 5), slice(k, 4))
            for i in range(1, 5) for j in range(1, 4) for k in range(1, 4)
        )
        gain, values = _quadrants(g, h, 2.0)
        assert abs(gain - (best - g.sum() ** 2 / (h.sum() + 2.0))) < 1e-9
        assert len({round(x, 9) for x in values.ravel()}) <= 4


def test_op8_at_2048(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in docs:
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for k, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : first if k == 0 else start + 2048]
            want.add((i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = queries.op8_best_fit_pack(spark, SMALL).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    bins: dict[int, list] = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(x)[:k]) for x in bins.values() for k, (o, _) in enumerate(sorted(x)))
    assert sorted(2048 - sum(n for _, n in x) for x in bins.values()) == brute.bins_of_best_fit([x[3] for x in want], 2048)


def test_packing_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    packed = corpus_pipeline.pack(spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_mixing_stage_against_plain_inversion(spark):
    """Counts by inverting the Poisson distribution in plain Python, a mean over 16 in parts."""
    import hashlib
    import math

    rows = [(i, "x" * 100, "big") for i in range(300)] + [(5000 + i, "x" * 10, "small") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    unit = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:13], 16) / (1 << 52)

    def inverse(u: float, mean: float) -> int:
        k, p, below = 0, math.exp(-mean), math.exp(-mean)
        while u >= below:
            k += 1
            p *= mean / k
            below += p
        return k

    have = {"big": 30_000.0, "small": 50.0}
    total, roots = sum(have.values()), sum(map(math.sqrt, have.values()))
    want = {}
    for i, _, source in rows:
        mean = math.sqrt(have[source]) * total / (roots * have[source])
        parts = max(math.ceil(mean / 16), 1)
        n = sum(inverse(unit(f"42:{i}" if k == 1 else f"42/part:{i}:{k}"), mean / parts) for k in range(1, parts + 1))
        want |= {(i, c): unit(f"42/shuffle:{i}:{c}") for c in range(n)}
    found = mix_sources(df, alpha=0.5, size=1.0, seed=42).collect()
    assert {(r.doc_id, r.copy): r.shuffle_key for r in found} == pytest.approx(want)
    assert [r.shuffle_key for r in found] == sorted(r.shuffle_key for r in found)


def test_line_stage_against_plain_templates(spark):
    """The templates of the stage in plain Python."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    parsed: dict[int, list] = {}
    for i, text in rows:
        for line in (text or "").encode().split(b"\n"):
            raw = line.split()
            if raw:
                t = tuple(raw if len(raw) < 5 else [b"<*>" if any(48 <= c < 58 for c in w) else w for w in raw])
                parsed.setdefault(i, []).append((line, t))
    lines = {(i, t) for i, x in parsed.items() for _, t in x}
    leaf = lambda t: (len(t), t[:3])
    count: dict = {}
    for _, t in lines:
        for place, w in enumerate(t):
            count[leaf(t), place, w] = count.get((leaf(t), place, w), 0) + 1

    def template(t: tuple) -> tuple:
        shape = tuple(w if count[leaf(t), k, w] >= 3 else b"<*>" for k, w in enumerate(t))
        constant = sum(w != b"<*>" for w in shape) / len(t)
        return ("general", leaf(t), shape) if constant >= 0.6 and len(t) >= 5 else ("own", leaf(t), t)

    holders: dict = {}
    for i, t in lines:
        holders.setdefault(template(t), set()).add(i)
    gone = {(i, t) for i, t in lines if len(holders[template(t)]) >= 3 and min(holders[template(t)]) != i}
    want = {}
    for i, text in rows:
        tokens = dict(parsed.get(i, []))
        want[i] = "\n".join(x.decode() for x in text.encode().split(b"\n") if (i, tokens.get(x)) not in gone)
    found = drop_recurring_lines(docs, min_docs=3, depth=3, min_tokens=5, min_constant=0.6, short_lines=True).collect()
    assert {r.doc_id: r.text for r in found} == want


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "some text", "a", 1), (2, "some text", "b", 2)], "doc_id long, text string, source string, x int")
    for name in ("copy", "shuffle_key", "n_lines", "n_dropped", "predicted", "held_out", "score"):
        named = df.withColumnRenamed("x", name)
        assert mix_sources(named).columns.count(name) == 1 and drop_recurring_lines(named).columns.count(name) == 1
        assert corpus_pipeline.mix(spark, named, "").columns == [c for c in named.columns if c not in ("copy", "shuffle_key")] or name in ("copy", "shuffle_key")


def test_no_folder_on_a_cluster(spark, monkeypatch):
    from corvia.llm import common

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)}), Context()

    with pytest.raises(ValueError):
        common.shared_folder(Session())


def test_runs_in_bucket_against_all_strings():
    draw, length = random.Random(7), 6
    for _ in range(60):
        parts = ["".join(draw.choices("ab", k=draw.randint(2, 9))).encode() for _ in range(4)]
        members = [p for p in {b"".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(20)} if len(p) >= length]
        seed, first = np.array([draw.randint(0, 2) for _ in members]), np.array([draw.randint(0, 5) for _ in members])
        found = runs_in_bucket(seed, first, members, length, array_pieces=2)
        for i, text in enumerate(members):
            earlier = {t[a : a + length] for t, s, f in zip(members, seed, first) if s == seed[i] and f < first[i] for a in range(len(t) - length + 1)}
            wanted = {a for a in range(len(text) - length + 1) if text[a : a + length] in earlier}
            assert {a for x, y in found.get(i, []) for a in range(x, y)} == wanted


def test_repeated_spans_read_texts_four_times(spark):
    """Once for all pieces, where their places come from too; for the k-mers of seeds with several pieces; to verify; to remove."""
    draw, seen = random.Random(3), spark.sparkContext.accumulator(0)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join([*(f"w{draw.randrange(10**6)}" for _ in range(50)), passage, f"tail{i}"])) for i in range(40)]

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    found = drop_repeated_spans(docs).drop("kept").collect()
    assert sorted(map(tuple, found)) == sorted(brute.repeated_words(rows, 35))
    assert seen.value <= 4 * len(rows)


def test_words_in_blocks_of_texts():
    texts = ["skipped", "", " a\tb\x0b\x0cc\r\n", "d", "e f", " \n", "nbsp\u00a0stays \u2003 \x1c \x85", "日本 straße", "\x00 \x00\x00", "x" * 5000 + " y", "x" * 255, "x" * 256, ""]
    column = pa.array(texts)[1:]
    data, first, bounds = words_of(column)
    words = [w for t in texts[1:] for w in t.encode().split()]
    assert [data[a:b].tobytes() for a, b in zip(first[:-1], first[1:])] == [w + b" " for w in words]
    assert np.diff(bounds).tolist() == [len(t.encode().split()) for t in texts[1:]]
    hashes = word_hashes(data, first).tolist()
    assert len(set(hashes)) == len(set(words)) and len(set(zip(words, hashes))) == len(set(words))
    many = words_of(pa.array([" ".join(f"v{i}" for i in range(70000)), *texts]))
    again = word_hashes(*many[:2])
    assert len(set(again[:70000].tolist())) == 70000 and again[70001:].tolist() == hashes
    for none in (pa.array([], pa.string()), pa.array(["", " "])):
        data, first, bounds = words_of(none)
        assert len(word_hashes(data, first)) == 0 and bounds.tolist() == [0] * (len(none) + 1)


@pytest.mark.parametrize("k", [1, 3, 12])
def test_pieces_in_blocks_of_texts(k):
    draw = random.Random(k)
    texts = [" ".join(draw.choices("abc", k=draw.choice([0, 1, 5, 40]))) for _ in range(60)] + ["r " * 2000, " ".join(f"w{i}" for i in range(300))] * 2
    data, first, bounds = words_of(pa.array(texts))
    each = word_hashes(data, first)
    seed, start, n, ph, again = pieces(each, bounds, k)
    edges, seeds, held = run_hashes(each, k), {}, {}
    for s, a, m, p, twice in zip(seed.tolist(), start.tolist(), n.tolist(), ph.tolist(), again.tolist()):
        own = edges[a : a + m].tolist()
        assert twice == (len(set(own)) < m)
        assert held.setdefault((s, p), own) == own
        for e in own:
            assert seeds.setdefault(e, s) == s
    want = [a for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()) for a in range(x, y - k + 1)]
    assert sorted(p for a, m in zip(start.tolist(), n.tolist()) for p in range(a, a + m)) == want


def test_paths_of_colliding_hashes_are_told_apart(spark):
    rows = [(1, "a b c d e"), (2, "x a  b\tc d"), (3, "q r s t"), (4, "a b c"), (4, "a b c")]
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    at = spark.createDataFrame([(1, 0, 2, 7), (2, 1, 2, 7), (3, 0, 2, 7), (3, 1, 1, 8), (4, 0, 1, 9), (1, 0, 1, 10), (2, 1, 1, 10)], "id long, start int, n int, path long")
    paths = docs.select("id", "th").distinct().join(at, "id").select("id", "th", "start", "n", "path")
    found = verified(docs, paths, 3).select("id", "start", "n").collect()
    assert sorted(map(tuple, found)) == [(1, 0, 1), (1, 0, 2), (2, 1, 1), (2, 1, 2), (4, 0, 1), (4, 0, 1)]
