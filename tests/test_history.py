from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators.history import HistoryStore, _in_parts, build, canonical_json, effective
from tessera.storage import scratch

T0 = datetime(2024, 1, 1)
DDL = "new string, seg string, effect timestamp, observed_at timestamp, valid_to timestamp"


def rows(n, keys, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        e = T0 + timedelta(hours=r.randrange(n))
        k = "hot" if r.random() < 0.34 else f"k{r.randrange(keys)}"
        out.append((k, r.choice(["a", "b", None]), e, e + timedelta(minutes=r.randrange(500)), e + timedelta(hours=r.randrange(1, 40)) if r.random() < 0.3 else None))
    return out


def expected(data):
    """Versions by a plain loop. ``new`` is the key here and ``seg`` the attribute: names the operator uses itself."""
    out = set()
    for k in {d[0] for d in data}:
        last: dict = {}
        for d in data:
            if d[0] == k:
                key = (d[3], d[1] is not None, d[1] or "", d[4] is not None, d[4] or T0)
                if d[2] not in last or key > last[d[2]][0]:
                    last[d[2]] = (key, d)
        versions = []
        for e in sorted(last):
            _, (_, a, _, _, vt) = last[e]
            if versions and versions[-1][1] == a and not (versions[-1][2] is not None and versions[-1][2] <= e):
                versions[-1][2] = vt
            else:
                versions.append([e, a, vt])
        for i, (s, a, vt) in enumerate(versions):
            ends = [x for x in (versions[i + 1][0] if i + 1 < len(versions) else None, vt) if x is not None]
            out.add((k, a, s, min(ends) if ends else None))
    return out


def test_against_loop_also_with_a_hot_key(spark):
    data = rows(1200, 40)
    df = spark.createDataFrame(data, DDL)
    for hot in (100, 1_000_000):
        got = {tuple(r) for r in build(df, ["new"], ["seg"], hot).select("new", "seg", "start", "end").collect()}
        assert got == expected(data)


def test_empty(spark):
    assert build(spark.createDataFrame([], DDL), ["new"], ["seg"]).count() == 0


def test_late_batches_rebuild_only_their_chains(spark):
    data = rows(900, 30, 5)
    r = random.Random(7)
    r.shuffle(data)
    store = HistoryStore(spark, scratch(spark, "history"), ["new"], ["seg"], 100, 16)
    for part in (data[:500], data[500:503], data[503:]):
        store.apply(spark.createDataFrame(part, DDL))
    rows_of = lambda df: {tuple(x) for x in df.select("new", "seg", "start", "end").collect()}
    assert rows_of(store.current()) == expected(data)
    store.compact()
    assert all(len(g) == 1 for g in store._manifest()["raw"].values()) and rows_of(store.current()) == expected(data)
    store.apply(spark.createDataFrame(data[:30], DDL))
    assert rows_of(store.current()) == expected(data)


def test_a_batch_reads_and_writes_touched_buckets_only(spark):
    data = [(f"k{i}", "a", T0 + timedelta(hours=h), T0 + timedelta(hours=h), None) for i in range(60) for h in range(3)]
    store = HistoryStore(spark, scratch(spark, "history"), ["new"], ["seg"], 100, 16)
    store.apply(spark.createDataFrame(data, DDL))
    before = store._manifest()
    late = [("k7", "b", T0 + timedelta(hours=1), T0 + timedelta(days=9), None)]
    store.apply(spark.createDataFrame(late, DDL))
    after = store._manifest()
    moved = {b for b in after["chains"] if after["chains"][b] != before["chains"][b]}
    assert len(before["chains"]) == 16 and len(moved) == 1 and {b for b in after["raw"] if len(after["raw"][b]) > 1} == moved
    read = {f.split("__bucket=")[1].split("/")[0] for f in store.raw(sorted(moved)).inputFiles()}
    assert read == moved
    assert {tuple(x) for x in store.current().select("new", "seg", "start", "end").collect()} == expected(data + late)
    # The manifest before still tells the state before, and one that never committed isn't seen.
    assert store.current(before).count() == len(expected(data))


def test_two_writers(spark):
    store = HistoryStore(spark, scratch(spark, "history"), ["new"], ["seg"])
    store.apply(spark.createDataFrame(rows(20, 3), DDL))
    with pytest.raises(RuntimeError):
        store._commit(store._manifest(), 0)


def test_hot_entities_are_cut_by_their_own_size(spark):
    data = [("hot" if i % 2 else f"k{i}", "a" if i % 3 else "b", T0 + timedelta(minutes=i), T0, None) for i in range(2000)]
    seen = effective(spark.createDataFrame(data, DDL), ["new"], ["seg"]).withColumnRenamed("seg", "a")
    hot = spark.createDataFrame([("hot", 1000, int((T0 - datetime(1970, 1, 1)).total_seconds()) * 10**6, int((T0 - datetime(1970, 1, 1)).total_seconds() + 2000 * 60) * 10**6)], "new string, n long, lo long, hi long")
    parts = _in_parts(seen, hot, ["new"], 100).filter("hot").groupBy("seg").count().collect()
    assert 10 <= len(parts) <= 11 and max(r["count"] for r in parts) <= 101


def test_canonical_json(spark):
    a = spark.createDataFrame([('{"a": 1, "b": {"y": 2, "x": "\\u00fc"}}', '{"b":{"x":"ü","y":2},"a":1}'), ("no json", "no json"), (None, None)], "a string, b string")
    assert a.select((canonical_json(F.col("a")).eqNullSafe(canonical_json(F.col("b")))).alias("same")).filter("not same").count() == 0
