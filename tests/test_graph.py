from __future__ import annotations

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions.temporal import parse_as_of, starts_near, valid_at
from tessera.graph import Graph, endpoints, top_per
from tessera.operators import candidates as cand
from tessera.schema import EDGES, NODES, conform, create_tables, missing_tables
from tessera.storage import scratch

T = datetime(2024, 1, 1)


def graph(spark, n=60, m=400, seed=1):
    r = random.Random(seed)
    nodes = [(f"n{i}", r.choice(["POI", "GeoArea", "Event"]), f"label {i % 7}", T, T if i % 9 == 0 else None) for i in range(n)]
    edges = []
    for i in range(m):
        a, b = r.randrange(n), r.randrange(n)
        edges.append((f"e{i}", r.choice(["LOCATED_IN", "RELATES_TO", "PART_OF"]), f"n{a}", f"n{a if i % 40 == 0 else b}", '{"relation": "%s"}' % r.choice(["mentions_area", "mentions_street"]), r.random() < 0.3, T if r.random() < 0.2 else None))
    g = Graph(
        conform(spark.createDataFrame(nodes, "id string, node_type string, label string, observed_at timestamp, valid_to timestamp"), NODES),
        conform(spark.createDataFrame(edges, "id string, edge_type string, from_node_id string, to_node_id string, properties string, inferred boolean, valid_to timestamp"), EDGES),
    )
    return g, nodes, edges


def test_as_of():
    assert parse_as_of(None) is None and parse_as_of(" ") is None
    assert parse_as_of("2024-01-01T10:00:00") == datetime(2024, 1, 1, 10, tzinfo=UTC)
    assert parse_as_of("2024-01-01T10:00:00+02:00").utcoffset().seconds == 7200
    with pytest.raises(ValueError):
        parse_as_of("yesterday")


def test_half_open(spark):
    df = spark.createDataFrame([(1, None, None), (2, datetime(2024, 1, 1), datetime(2024, 2, 1)), (3, datetime(2024, 2, 1), None)], "i int, valid_from timestamp, valid_to timestamp")
    ids = lambda at: {r["i"] for r in df.filter(valid_at(at)).collect()}
    assert ids("2024-01-01") == {1, 2} and ids("2024-02-01") == {1, 3} and ids("2023-01-01") == {1} and ids(None) == {1, 3}
    near = df.select("i", starts_near(F.lit(datetime(2024, 1, 20)), F.col("valid_from"), F.col("valid_to"), 10).alias("n")).collect()
    assert [r["n"] for r in near] == [True, True, False]


def test_degree_neighbours_and_subgraphs(spark):
    g, nodes, edges = graph(spark)
    now = [e for e in edges if e[6] is None]
    facts = [e for e in now if not e[5]]
    open_nodes = {n[0] for n in nodes if n[4] is None}
    assert {r["node_id"]: r["degree"] for r in g.degree().collect()} == {n: d for n in open_nodes if (d := sum(n in (e[2], e[3]) for e in facts))}
    ids = spark.createDataFrame([("n1",), ("n2",), ("n3",), ("n3",)], "id string")
    some = {"n1", "n2", "n3"}
    assert {r["id"] for r in g.induced(ids).collect()} == {e[0] for e in now if e[2] in some and e[3] in some}
    assert {r["id"] for r in g.induced(ids, False).collect()} == {e[0] for e in facts if e[2] in some and e[3] in some}
    assert sorted(r["id"] for r in g.touching(ids).collect()) == sorted(e[0] for e in facts if e[2] in some or e[3] in some)
    assert sorted(r["id"] for r in g.incident(ids).collect()) == sorted(e[0] for e in now if e[2] in some or e[3] in some)
    assert {r["id"] for r in g.incident(ids, "in").collect()} == {e[0] for e in now if e[3] in some}
    assert {tuple(r) for r in g.neighbours(ids).collect()} == {(a, b) for e in facts for a, b in ((e[2], e[3]), (e[3], e[2])) if a in some}
    assert endpoints(g.edges.filter("from_node_id = to_node_id"), "id").count() == sum(e[2] == e[3] for e in edges)
    with pytest.raises(ValueError):
        g.incident(ids, "sideways")


def test_lists_and_search(spark):
    g, nodes, _ = graph(spark)
    page = [r["id"] for r in g.list_nodes(limit=5, offset=2).collect()]
    assert page == sorted(n[0] for n in nodes if n[4] is None)[2:7]
    assert g.list_nodes(node_type="POI", limit=None).filter("node_type <> 'POI'").count() == 0
    with pytest.raises(ValueError):
        g.list_nodes(limit=501)
    found = g.search("label 3").collect()
    assert found[0]["similarity"] == 1.0 and found[0]["label"] == "label 3"
    assert top_per(g.nodes, ["node_type"], [F.col("id")], 2).count() == 6


def test_candidates(spark):
    g, nodes, edges = graph(spark)
    every = cand.collected(cand.ego_network(g), "ego_network").unionByName(cand.collected(cand.area_bridge(g), "area_bridge"))
    kept = cand.deduplicated(every).collect()
    assert len({frozenset(r["node_ids"]) for r in kept}) == len(kept) == len({frozenset(r["node_ids"]) for r in every.collect()})
    same = spark.createDataFrame([("ego_network", "a", ["a", "b"]), ("area_bridge", "b", ["b", "a", "a"]), ("unknown", "c", ["c"])], "generator string, anchor_id string, node_ids array<string>")
    assert {(r["generator"], r["anchor_id"]) for r in cand.deduplicated(same).collect()} == {("area_bridge", "b"), ("unknown", "c")}
    s = cand.subgraphs(every, g).collect()
    open_nodes = {n[0] for n in nodes if n[4] is None}
    members = {(r["generator"], r["anchor_id"]): set(r["node_ids"]) for r in every.collect()}
    for r in s:
        m = members[r["generator"], r["anchor_id"]]
        assert {n["id"] for n in r["nodes"]} == m & open_nodes
        assert {e["id"] for e in r["edges"]} == {e[0] for e in edges if e[6] is None and not e[5] and e[2] in m and e[3] in m}
    assert cand.diverse(every, g.nodes).filter("n_types < 2").count() == 0


def test_insights(spark):
    ddl = "insight_type string, title string, confidence double, node_ids array<string>"
    p = spark.createDataFrame([("t", "x", 0.9, ["b", "a"]), ("t", "y", 0.8, ["a", "b"]), ("u", "z", 0.7, ["a", "b"]), ("t", "low", 0.69, ["c"]), ("t", None, None, ["d"])], ddl)
    none = spark.createDataFrame([], "candidate_key string")
    new = cand.new_insights(p, none)
    assert {r["title"] for r in new.collect()} == {"x", "z"}
    assert cand.new_insights(p, new).count() == 0
    i = new.withColumns({"id": F.col("candidate_key"), "status": F.lit("new"), "created_at": F.lit(T)})
    one = i.first()["id"]
    assert cand.stored_insights(cand.set_status(i, one, "confirmed"), status="confirmed").count() == 1
    with pytest.raises(ValueError):
        cand.set_status(i, one, "odd")
    with pytest.raises(KeyError):
        cand.set_status(i, "absent", "new")


def test_tables(spark):
    path = scratch(spark, "tables")
    assert len(missing_tables(spark, path)) == 5
    create_tables(spark, path)
    assert missing_tables(spark, path) == []
