from __future__ import annotations

import random
from datetime import datetime, timedelta

from tessera.operators.dedup import in_storage, ingest, look_up, stored_hits, surplus, unique_messages
from tessera.storage import scratch

T0 = datetime(2024, 1, 1)
DDL = "delivery_id bigint, k string, received_at timestamp, __n string"


def rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        # A third of all rows are one message.
        k = None if r.random() < 0.05 else "hot" if r.random() < 0.33 else f"m{r.randrange(n // 2)}"
        out.append((i, k, None if r.random() < 0.02 else T0 + timedelta(days=r.randrange(900)), "x"))
    return out


def expected(data):
    first: dict = {}
    for i, k, t, _ in data:
        if k is not None:
            first[k] = min(first.get(k, (True, datetime.max, 1 << 60)), (t is None, t or datetime.max, i))
    return {i for i, k, t, _ in data if k is not None and first[k][2] != i}


def test_against_brute_force(spark):
    data = rows(4000)
    df = spark.createDataFrame(data, DDL)
    got = surplus(df, ["k"], "delivery_id", "received_at")
    assert got.columns == df.columns
    assert {r["delivery_id"] for r in got.collect()} == expected(data)
    kept = unique_messages(df, ["k"], "delivery_id", "received_at")
    assert kept.count() == len(data) - len(expected(data))


def test_empty_and_all_null(spark):
    assert surplus(spark.createDataFrame([], DDL), ["k"], "delivery_id", "received_at").count() == 0
    assert surplus(spark.createDataFrame([(1, None, T0, "a"), (2, None, T0, "a")], DDL), ["k"], "delivery_id", "received_at").count() == 0


def test_exact_comparison_and_ties(spark):
    df = spark.createDataFrame([(2, "A", T0, ""), (1, "A", T0, ""), (3, "a", T0, ""), (4, "", T0, ""), (5, "", T0, ""), (6, "long" * 20_000, T0, ""), (7, "long" * 20_000, T0, "")], DDL)
    assert {r["delivery_id"] for r in surplus(df, ["k"], "delivery_id", "received_at").collect()} == {2, 5, 7}


def test_batches_and_replay(spark):
    data = rows(1500, 3)
    store = scratch(spark, "store")
    parts = [data[:500], data[500:1000], data[1000:]]
    got, again = [], []
    for n, part in enumerate(parts):
        df = spark.createDataFrame(part, DDL)
        got.append(sorted(r["delivery_id"] for r in ingest(df, store, n, ["k"], "delivery_id", "received_at").collect()))
        again.append(sorted(r["delivery_id"] for r in ingest(df, store, n, ["k"], "delivery_id", "received_at").collect()))
    assert got == again
    ids = [i for g in got for i in g]
    kept = [data[i] for i in ids]
    assert len({k for _, k, _, _ in kept if k is not None}) == len([1 for _, k, _, _ in kept if k is not None])
    assert {k for _, k, _, _ in kept} == {k for _, k, _, _ in data}


def test_repeats_of_one_delivery(spark):
    """The same delivery twice, with one id: exactly one copy stays."""
    df = spark.createDataFrame([(1, "a", T0, ""), (1, "a", T0, ""), (2, "a", T0, ""), (3, "b", None, ""), (3, "b", None, "z"), (4, None, T0, ""), (4, None, T0, "")], DDL)
    rows = unique_messages(df, ["k"], "delivery_id", "received_at").collect()
    assert sorted((r["delivery_id"], r["k"]) for r in rows if r["k"]) == [(1, "a"), (3, "b")] and sum(r["k"] is None for r in rows) == 2


def test_filters_screen_and_buckets_are_pruned(spark):
    """A batch is compared with the storage of the buckets its filters hit, no others."""
    store, keys = scratch(spark, "store"), ["k"]
    old = spark.createDataFrame([(i, f"m{i}", T0 + timedelta(days=150 * (i % 6)), "") for i in range(3000)], DDL)
    ingest(old, store, 0, keys, "delivery_id", "received_at")
    again = spark.createDataFrame([(9000 + i, f"m{6 * i}", T0 + timedelta(days=2000), "") for i in range(20)] + [(9500 + i, f"new{i}", T0 + timedelta(days=2000), "") for i in range(500)], DDL)
    fresh = in_storage(again, keys, "delivery_id", "received_at")
    hits = stored_hits(spark, fresh, store, 1, 1 << 18).collect()
    # All repeats hit the bucket they are in (every sixth message lies in the first); of the new ones next to none hits any.
    assert 20 <= len(hits) <= 25
    first = min(r["__tb"] for r in hits)
    found = look_up(spark, fresh.schema, store, 1, [first], spark.createDataFrame(hits, "__h long, __tb long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = [p for p in plan.split("PartitionFilters: ")[1:] if "__tb" in p.split("]")[0] and str(first) in p.split("]")[0]]
    assert found.count() == 20 and pruned, plan
    kept = ingest(again, store, 1, keys, "delivery_id", "received_at")
    assert {r["k"] for r in kept.collect()} == {f"new{i}" for i in range(500)}
