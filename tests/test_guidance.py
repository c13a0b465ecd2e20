"""Guidance and rule catalogs from files, checked, and used on documents."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest

from corvia.operators.rules import check, rule_matches
from corvia.plans.catalog import DEFAULT, GUARDED, Catalog, CatalogError
from corvia.plans.guidance import GUIDANCE, Guidance
from tests.conftest import SMALL


def test_guidance_round_trip(tmp_path):
    (tmp_path / "g.json").write_text(GUIDANCE.dump())
    assert Guidance.load(tmp_path / "g.json") == GUIDANCE
    assert Guidance.load(tmp_path / "g.json").version == GUIDANCE.version


@pytest.mark.parametrize(
    "change, what",
    [
        (lambda d: d["sources"][0].update(id="style"), "repeated id"), (lambda d: d["sources"][0].update(url="http://example.org/x"), "address"), (lambda d: d["sources"][0].update(url="https://example.org.evil.net/x"), "address"),
        (lambda d: d["sources"][0].update(url="https://u:p@example.org/x"), "address"), (lambda d: d["sources"][0].update(accessed="2024-1-1"), "date"), (lambda d: d["sources"][0].update(accessed="2030-01-01"), "after"),
        (lambda d: d["sources"][0].update(kind="rumour"), "rumour"), (lambda d: d["sources"][0].update(title=""), "empty"), (lambda d: d["controls"][0].update(sources=["nowhere"]), "unknown source"),
        (lambda d: d["controls"][0].update(sources=["style", "style"]), "twice"), (lambda d: d["controls"][0].update(scope="some"), "some"), (lambda d: d["profiles"][0].update(sources=[]), "empty"), (lambda d: d.update(profiles=[]), "no profiles"),
        (lambda d: d.update(more=1), "more"), (lambda d: d["controls"][0].update(more="x"), "more"), (lambda d: d["controls"][0].update(questions="Q-LINK"), "another kind"), (lambda d: d["sources"][0].pop("url"), "url"), (lambda d: d.pop("hosts"), "hosts"),
        (lambda d: d["sources"][0].update(title=3), "another kind"),
    ],
)
def test_guidance_rejects(tmp_path, change, what):
    data = json.loads(GUIDANCE.dump())
    change(data)
    (tmp_path / "g.json").write_text(json.dumps(data))
    with pytest.raises(CatalogError, match=what):
        Guidance.load(tmp_path / "g.json")


def test_guidance_names_known_questions():
    with pytest.raises(CatalogError, match="unknown question Q-NEVER"):
        replace(GUIDANCE, controls=(replace(GUIDANCE.controls[0], questions=("Q-NEVER",)),)).checked(DEFAULT)


def test_catalog_file_checks_documents(spark, tmp_path):
    for catalog in (DEFAULT, GUARDED):
        (tmp_path / "c.json").write_text(catalog.dump())
        loaded = Catalog.load(tmp_path / "c.json")
        assert loaded == catalog and loaded.version == catalog.version and loaded.matching_version == catalog.matching_version
        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
        assert sorted(map(str, rule_matches(docs, loaded).collect())) == sorted(map(str, rule_matches(docs, catalog).collect()))
    assert {r.catalog_version for r in check(docs, loaded).select("catalog_version").distinct().collect()} == {GUARDED.version}


@pytest.mark.parametrize("change, what", [(lambda d: d["rules"][0].update(more=1), "more"), (lambda d: d["slots"][0].update(more=1), "more"), (lambda d: d.update(more=1), "more"), (lambda d: d["articles"][0].update(more=1), "more"), (lambda d: d["rules"][0].pop("severity"), "severity"), (lambda d: d.pop("slots"), "slots")])
def test_catalog_file_rejects(tmp_path, change, what):
    data = json.loads(DEFAULT.dump())
    change(data)
    (tmp_path / "c.json").write_text(json.dumps(data))
    with pytest.raises(CatalogError, match=what):
        Catalog.load(tmp_path / "c.json")


def test_needed_literals_stand_in_all_matches(spark):
    """No rule matches a text without one of the literals that let the text past the gate."""
    from corvia.operators.rules import Texts, presence_rules

    rows = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()] + ["a@b.org", 'TOKEN\t=\n"x"', "ABC!!", "x | y | z", "secret= \"\"", 'api_key="q"']
    seen = set()
    for rule in presence_rules(GUARDED):
        for text in rows:
            if Texts(text).spans(rule.patterns) and rule.needs:
                seen.add(rule.id)
                assert any(x in text for x in rule.needs)
    assert seen == {r.id for r in GUARDED.rules if r.needs}


def test_chosen_rules(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = lambda catalog: sorted(str(r) for r in rule_matches(docs, catalog).collect())
    some = DEFAULT.only(["P-ADDR", "Q-NOISE"])
    assert [r.id for r in some.rules] == ["P-ADDR", "Q-NOISE"] and some.rules[0].related == ()
    assert rows(some) == [x for x in rows(DEFAULT) if "'P-ADDR'" in x or "'Q-NOISE'" in x]
    assert {r.layer for r in DEFAULT.only(layers=["policy"]).rules} == {"policy"}
    for ids, layers, what in ((["Q-RIGHTS"], ("question",), "Q-RIGHTS"), (["P-ADDR"], ("question",), "P-ADDR"), (["P-ADDR", "P-ADDR"], ("policy",), "twice")):
        with pytest.raises(CatalogError, match=what):
            DEFAULT.only(ids, layers)
