from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation, linking, resolution, runs
from tessera.operators.upsert import more_than_one_open, unseen, upsert_edges, upsert_nodes
from tessera.schema import CANDIDATES, EDGES, NODES, RUNS, conform
from tessera.sources import registry

T = [datetime(2024, 1, d) for d in range(1, 9)]
SHORT = "source string, source_id string, label string, properties string, observed_at timestamp"


def nodes(spark, rows):
    return conform(spark.createDataFrame(rows, SHORT), NODES)


def state(df):
    return sorted((r["source_id"] or "", r["label"], r["observed_at"], r["valid_to"] or datetime.max) for r in df.collect())


def test_versions(spark):
    empty = spark.createDataFrame([], NODES)
    batch = nodes(spark, [("s", "a", "A", '{"x": 1, "y": 2}', T[0]), ("s", "b", "B", "{}", T[0]), ("s", None, "N", "{}", T[0]), ("s", "", "E", None, T[0]), ("s", "b", "B2", "{}", T[1])])
    one = upsert_nodes(empty, batch, F.lit(T[2]))
    assert {r["change"] for r in one.collect()} == {"inserted"}
    assert state(one) == [("", "E", T[2], datetime.max), ("", "N", T[2], datetime.max), ("a", "A", T[2], datetime.max), ("b", "B2", T[2], datetime.max)]
    again = upsert_nodes(one.drop("change"), nodes(spark, [("s", "a", "A", '{"y":2,"x":1}', T[3]), ("s", "b", "B3", "{}", T[3])]), F.lit(T[4]))
    assert sorted((r["source_id"] or "", r["change"]) for r in again.collect()) == [("", "untouched"), ("", "untouched"), ("a", "touched"), ("b", "closed"), ("b", "inserted")]
    assert more_than_one_open(again).count() == 0
    # Run again, the batch changes nothing but the time.
    third = upsert_nodes(again.drop("change"), nodes(spark, [("s", "b", "B3", "{}", T[3])]), F.lit(T[5]))
    assert sorted(r["change"] for r in third.collect()) == ["touched", "untouched", "untouched", "untouched", "untouched"]
    assert upsert_nodes(empty, empty, F.lit(T[0])).count() == 0


def test_edges(spark):
    ddl = "id string, edge_type string, from_node_id string, to_node_id string, source string, source_id string, observed_at timestamp, valid_to timestamp"
    e = lambda rows: conform(spark.createDataFrame(rows, ddl), EDGES)
    table = e([("1", "PART_OF", "a", "b", "s", "k", T[0], None), ("2", "PART_OF", "a", "c", "s", "closed", T[0], T[1])])
    batch = e([("3", "PART_OF", "x", "y", "s", "k", T[2], None), ("4", "PART_OF", "a", "c", "s", "closed", T[2], None), ("5", "PART_OF", "q", "r", "s", None, T[2], None), ("6", "PART_OF", "q", "r", "s", None, T[3], None)])
    out = upsert_edges(table, batch, F.lit(T[4]))
    assert sorted((r["source_id"], r["change"]) for r in out.collect()) == [("PART_OF:q:r", "inserted"), ("closed", "inserted"), ("closed", "untouched"), ("k", "touched")]
    assert upsert_edges(out.drop("change"), batch, F.lit(T[5])).filter("change = 'inserted'").count() == 0


def test_unseen(spark):
    items = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert {r["k"] for r in unseen(items, items.filter("k = 'a'"), "k").collect()} == {"b", None}


def test_runs(spark):
    r = spark.createDataFrame([("a", T[0], T[1], "ok", 1, 1, "c1", None), ("a", T[2], T[3], "error", 0, 0, "bad", "x"), ("b", T[1], None, "running", None, None, None, None)], RUNS)
    assert {(x["connector"], x["status"]) for x in runs.latest_run(r).collect()} == {("a", "error"), ("b", "running")}
    assert [tuple(x) for x in runs.latest_checkpoint(r).collect()] == [("a", "c1")]
    more = runs.finished(runs.started(r, "a", F.lit(T[4])), "a", F.lit(T[4]), F.lit(T[5]), "ok", 3, 4, "c2")
    assert [tuple(x) for x in runs.latest_checkpoint(more).collect()] == [("a", "c2")]
    status = runs.source_status(registry.catalogue(spark), r)
    assert status.count() == len(registry.SOURCES) == 20 and sum(not s[4] for s in registry.SOURCES) == 1
    assert all(len(s[2].split()) == 5 and s[1] in ("reference", "snapshot", "event_stream") for s in registry.SOURCES)


def test_resolution(spark):
    ddl = "id string, source string, node_type string, label string, lat double, lon double"
    rows = [("1", "a", "POI", "Am Markt", 51.0, 7.0), ("2", "b", "POI", "AM MARKT", 51.0001, 7.0), ("3", "b", "POI", "Am Markt", 51.1, 7.0), ("4", "a", "POI", "Am Markt", 51.0, 7.0), ("5", "b", "Road", "Am Markt", 51.0, 7.0), ("6", "b", "POI", None, 51.0, 7.0), ("7", "b", "POI", "Am Markt", None, 7.0), ("8", "b", "POI", "Am Marktt", 51.0, 7.0)]
    n = conform(spark.createDataFrame(rows, ddl), NODES)
    assert {(r["node_a_id"], r["node_b_id"]) for r in resolution.geo_candidates(n).collect()} == {("1", "2"), ("2", "4")}
    sim = {(r["label_a"], r["label_b"]): (r["n_a"], r["n_b"], round(r["similarity"], 3)) for r in resolution.similar_labels(n, "POI", 0.7).collect()}
    assert sim == {("Am Markt", "AM MARKT"): (2, 1, 1.0), ("Am Markt", "Am Markt"): (2, 2, 1.0), ("Am Markt", "Am Marktt"): (2, 1, 0.727)}
    t = spark.createDataFrame([(0.95,), (0.949,), (0.7,), (0.69,)], "c double").select(resolution.triage(F.col("c")).alias("t"))
    assert [r["t"] for r in t.collect()] == ["merge", "review", "review", "drop"]
    c = conform(spark.createDataFrame([("c1", "1", "2", "geo", 0.9, None), ("c2", "1", "3", "geo", 0.8, True)], "id string, node_a_id string, node_b_id string, method string, confidence double, resolved boolean"), CANDIDATES)
    assert resolution.review_queue(c, n).count() == 1 and resolution.review_queue(c, n, "all").count() == 2
    done, edge = resolution.resolve(c, "c1", True, "me", F.lit(T[0]))
    assert resolution.review_queue(done, n).count() == 0 and edge.count() == 1
    with pytest.raises(ValueError):
        resolution.resolve(c, "c2", True, "me", F.lit(T[0]))
    with pytest.raises(KeyError):
        resolution.resolve(c, "c3", True, "me", F.lit(T[0]))
    pairs = spark.createDataFrame([("1", "2", 0.8, "geo"), ("1", "2", 0.9, "name"), ("1", "3", 0.9, "name")], "node_a_id string, node_b_id string, confidence double, method string")
    assert [tuple(r) for r in resolution.new_candidates(pairs, c.filter("id = 'c2'")).collect()] == [("1", "2", 0.9, "name")]


def test_names_against_brute_force(spark):
    import random

    r = random.Random(4)
    words = ["grundschule", "turnhalle", "am", "alte", "wiese", "bach", "hof", "kamp", "berg"]
    rows = [(str(i), r.choice("ab"), "POI", " ".join(r.choice(words) for _ in range(r.randrange(1, 5)))) for i in range(150)]
    n = conform(spark.createDataFrame(rows, "id string, source string, node_type string, label string"), NODES)

    def grams(t):
        return {p[i : i + 3] for w in t.split() for p in [f"  {w} "] for i in range(len(p) - 2)}

    labels = {(s, t) for _, s, _, t in rows}
    want = {(a, b) for s, a in labels for u, b in labels if s == "a" and u == "b" and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.8}
    assert {(x["label_a"], x["label_b"]) for x in resolution.similar_labels(n, "POI").collect()} == want


def test_scores(spark):
    g = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "b"), ("3", "x")], "e string, i string")
    p = spark.createDataFrame([("1", "a"), ("1", "c"), ("2", "z")], "e string, i string")
    s = {r["e"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) for r in evaluation.scores(evaluation.counts(g, p, ["e"], ["i"])).collect()}
    assert s == {"1": (1, 1, 1, 0.5, 0.5, 0.5), "2": (0, 1, 0, 0.0, 1.0, 0.0), "3": (0, 0, 1, 1.0, 0.0, 0.0)}
    assert tuple(evaluation.micro(evaluation.counts(g, p, ["e"], ["i"])).first()) == (1, 2, 2, 0.3333, 0.3333, 0.3333)
    assert tuple(evaluation.micro(evaluation.counts(g.limit(0), p.limit(0), ["e"], ["i"])).first()) == (0, 0, 0, 1.0, 1.0, 1.0)


def test_links(spark):
    c = conform(spark.createDataFrame([("1", "Huckarde"), ("2", None), ("3", "nowhere")], "id string, label string"), NODES)
    a = conform(spark.createDataFrame([("A", "HUCKARDE")], "id string, label string"), NODES)
    none = spark.createDataFrame([], EDGES)
    got = linking.part_of_by_name(c, a, none, F.col("label"))
    assert [tuple(r) for r in got.collect()] == [("1", "A")]
    e = conform(linking.as_edges(got, "PART_OF", "link", F.lit(T[0])), EDGES)
    assert linking.part_of_by_name(c, a, e, F.col("label")).count() == 0
    assert {r["id"] for r in linking.orphans(c, a, F.lower("label"), F.lower("label")).collect()} == {"3"}


def test_names_that_share_frequent_words(spark):
    """Thousands of labels with the same words: their pairs are compared as matrices, not joined row by row, and none is lost."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    n = 600
    w = r.integers(-(2**63), 2**63, (n, 2))
    w[n // 2 :] = w[: n // 2]  # of the other source, alike
    names, size = np.repeat(["a", "b"], n // 2), np.full(n, 20, np.int32)
    t = pa.table({"key": np.full(n, 7), "h": np.arange(n), "source": names.tolist(), "size": size, "w0": w[:, 0], "w1": w[:, 1]})
    got = resolution._alike(0.8)(t)
    assert {(x["ha"], x["hb"]) for x in got.to_pylist()} == {(i, i + n // 2) for i in range(n // 2)}
