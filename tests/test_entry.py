"""Every query with SQL gives the SQL's rows on the small test tables."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from tessera.plans import catalogue

duckdb = pytest.importorskip("duckdb")


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in os.listdir(data):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{data}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, data, con, name):
    df = catalogue.QUERIES[name](spark, data)
    r = con.sql(catalogue.SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    cols = sorted(df.columns)
    at = [r.columns.index(c) for c in cols]
    got = Counter(repr(tuple(norm(x[c]) for c in cols)) for x in df.collect())
    want = Counter(repr(tuple(norm(x[i]) for i in at)) for x in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, data, name):
    a, b = (sorted(map(repr, catalogue.QUERIES[name](spark, data).collect())) for _ in range(2))
    assert a == b
    assert a or name == "candidate_payload"  # none has two types of nodes in the smallest tables


def test_contract(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
