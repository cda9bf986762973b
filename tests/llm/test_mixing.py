from __future__ import annotations

import math
import random

import pytest

from tessera.llm.mixing import mix, shares

TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.25, 3), (None, 0.1, 1), ("zero", 0.0, 1)]


def sizes(spark, n=6000):
    r = random.Random(2)
    rows = [(i, r.choice(["a"] * 6 + ["b"] * 3 + ["c", "zero", "other", None]), int(r.lognormvariate(4, 1)), "x") for i in range(n)]
    rows += [(n, "a", 0, "x"), (n + 1, "b", None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, rate string"), rows


def used(rows):
    by: dict = {}
    for r in rows:
        by[r["source"]] = by.get(r["source"], 0) + r["tokens"] * r["copies"]
    return by


def test_shares_and_caps(spark):
    df, _ = sizes(spark)
    mixed, aimed = mix(df, TARGETS)
    rows = mixed.collect()
    assert aimed == pytest.approx({"a": 0.5, "b": 0.3, "c": 0.2})
    assert all(r["copies"] <= {"a": 1, "b": 2, "c": 4}[r["source"]] for r in rows)
    by = used(rows)
    total = sum(by.values())
    for s, v in aimed.items():
        assert by[s] / total == pytest.approx(v, abs=0.005)


def test_rates_are_tilted_and_least_surprising(spark):
    """min(cap, exp(lambda t / mean)) for one lambda a source: the condition for the entropy's optimum."""
    df, _ = sizes(spark)
    rows = mix(df, TARGETS, 60_000)[0].collect()
    for s, cap in (("a", 1), ("b", 2), ("c", 4)):
        mine = [r for r in rows if r["source"] == s and r["rate"] < cap * (1 - 1e-9)]
        mean = sum(r["tokens"] for r in rows if r["source"] == s) / sum(1 for r in rows if r["source"] == s)
        tilts = [math.log(r["rate"]) * mean / r["tokens"] for r in mine]
        assert max(tilts) - min(tilts) < 1e-6
        assert sum(r["rate"] * r["tokens"] for r in rows if r["source"] == s) == pytest.approx({"a": 30_000, "b": 18_000, "c": 12_000}[s], rel=1e-6)
        assert all(math.floor(r["rate"]) <= r["copies"] <= math.floor(r["rate"]) + 1 for r in rows)


def test_a_total_that_a_source_cannot_fill(spark):
    df, rows = sizes(spark)
    mixed = mix(df, TARGETS, 1e9)[0].collect()
    assert all(r["copies"] == {"a": 1, "b": 2, "c": 4}[r["source"]] for r in mixed)


def test_empty(spark):
    df, _ = sizes(spark, 50)
    assert mix(df, [])[0].count() == 0 and mix(df.limit(0), TARGETS)[0].count() == 0 and mix(df, [("gone", 1.0, 1)])[0].count() == 0


def test_report(spark, data):
    rows = {r["source"]: r for r in shares(spark, data).collect()}
    assert rows["stadtarchiv"]["actual_share"] == 0 and rows["ods_pois"]["target_share"] is None
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1, abs=1e-4)
