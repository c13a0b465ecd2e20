"""Every query of the library against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from corvia.plans import registry
from corvia.plans.all import MODULES  # noqa: F401
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    found = registry.QUERIES[name](spark, SMALL)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(repr(plain(tuple(r))) for r in found.select(columns).collect()) == sorted(repr(plain(r)) for r in want.fetchall())


def test_split_is_exact(spark):
    found = registry.QUERIES["stratified_split"](spark, SMALL).groupBy("split").count().collect()
    n = {r.split: r["count"] for r in found}
    assert n["holdout"] == round(0.3 * sum(n.values()))
