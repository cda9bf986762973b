from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators.spatial_join import Quadtree, RTree, edges_for, edges_of, great_circle_m, inside_edges, inside_rings, near_and_inside, spatial_pairs

AREA = "area string, rings array<array<array<double>>>"
SQUARE = [[7.0, 51.0], [7.1, 51.0], [7.1, 51.1], [7.0, 51.1], [7.0, 51.0]]
HOLE = [[7.04, 51.04], [7.04, 51.06], [7.06, 51.06], [7.06, 51.04]]


def points(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        c = (51.05 + r.gauss(0, 0.001), 7.05 + r.gauss(0, 0.001)) if r.random() < 0.6 else (51 + r.random() * 0.2, 7 + r.random() * 0.2)
        out.append((f"e{i}", round(c[0], 5), round(c[1], 5)))
    out += [("same1", 51.05, 7.05), ("same2", 51.05, 7.05), ("same1", 51.05, 7.05), ("two", 51.0, 7.0), ("two", 51.05, 7.05), (None, 51.0, 7.0), ("lost", None, 7.0)]
    return out


def test_near_and_inside_against_brute_force(spark):
    data = points(1500)
    el = spark.createDataFrame(data, "id string, lat double, lon double").withColumn("area", F.lit("clash"))
    ar = spark.createDataFrame([("A", [SQUARE, HOLE]), ("A", [SQUARE, HOLE]), ("H", [HOLE[::-1]]), ("none", None), ("empty", [])], AREA)
    got = {tuple(r) for r in near_and_inside(el, ar, 60.0).collect()}
    known = sorted({d for d in data if None not in d})
    lat, lon = np.array([d[1] for d in known]), np.array([d[2] for d in known])
    want = set()
    for i, (a, la, lo) in enumerate(known):
        for j in np.flatnonzero(great_circle_m(la, lo, lat, lon) <= 60.0):
            if a < known[j][0]:
                want.add(("near", a, known[j][0]))
        for name, rings in (("A", [SQUARE, HOLE]), ("H", [HOLE])):
            if inside_rings(lat[i : i + 1], lon[i : i + 1], [np.array(r) for r in rings])[0]:
                want.add(("inside", name, a))
    assert got == want


def test_leaves_cut_the_data_and_lose_no_pair(spark):
    p = spark.createDataFrame([d[1:] for d in points(3000, 2) if None not in d], "lat double, lon double").distinct()
    none = spark.createDataFrame([], AREA)
    small, large = (spatial_pairs(p, none, 30.0, 500, rows).drop("area") for rows in (2_000, 20_000))
    assert small.count() == large.distinct().count() == small.distinct().count()


def test_empty(spark):
    el = spark.createDataFrame([], "id string, lat double, lon double")
    assert near_and_inside(el, spark.createDataFrame([("A", [SQUARE])], AREA), 20.0).count() == 0


def test_date_line_and_pole(spark):
    """Neighbours across the 180th meridian, and around a pole, among positions all over the globe."""
    r = random.Random(3)
    data = [("w", 10.0, -179.999995), ("e", 10.0, 179.999995), ("n1", 89.99995, 10.0), ("n2", 89.99995, -170.0), ("s1", -89.99999, 0.0), ("s2", -89.99999, 90.0), ("z", 10.0, 180.0)]
    data += [(f"x{i}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(500)]
    got = {tuple(x)[1:] for x in near_and_inside(spark.createDataFrame(data, "id string, lat double, lon double"), spark.createDataFrame([], AREA), 20.0).collect()}
    assert got == {("e", "w"), ("e", "z"), ("w", "z"), ("n1", "n2"), ("s1", "s2")}


def test_a_dense_spot_is_probed_in_shares(spark):
    """More distinct positions than a leaf may hold within one search box: no pair is lost or doubled."""
    r = random.Random(5)
    data = [(f"e{i}", 51 + r.random() * 5e-5, 7 + r.random() * 5e-5) for i in range(300)] + [("far1", 50.0, 6.0), ("far2", 52.0, 9.0)]
    lat, lon = (np.array([d[k] for d in data]) for k in (1, 2))
    tree = Quadtree((50, 6, 52.1, 9.1), 10, lat, lon, 20)
    assert tree.shares.max() >= 15 and tree.shares.sum() < 60
    p = spark.createDataFrame([d[1:] for d in data], "lat double, lon double")
    square = [[6.5, 50.5], [7.5, 50.5], [7.5, 51.5], [6.5, 51.5]]
    from tessera.operators import spatial_join as sj

    got = sj.spatial_pairs(p, spark.createDataFrame([("A", [square])], AREA), 20.0).groupBy("kind").count().collect()
    want = int((great_circle_m(lat[:, None], lon[:, None], lat, lon) <= 20).sum() - len(data)) // 2
    assert {x["kind"]: x["count"] for x in got} == {"near": want, "inside": 300}


def test_clipped_regions_decide_as_whole_ones():
    """A polygon of 100,000 points, cut for each leaf: the same answers from a fraction of the edges."""
    r = np.random.default_rng(2)
    t = np.sort(r.random(100_000)) * 2 * np.pi
    radius = 0.4 + 0.02 * np.sin(40 * t) + 0.001 * r.random(len(t))
    ring = np.column_stack([7.5 + radius * np.cos(t), 51.5 + radius * np.sin(t)])
    hole = [[7.4, 51.4], [7.6, 51.4], [7.6, 51.6], [7.4, 51.6]]
    edges = edges_of([ring.tolist(), hole])
    lat, lon = 51 + r.random(3000), 7 + r.random(3000)
    tree = Quadtree((51, 7, 52, 8), 5, lat, lon, 20)
    leaves, want, sent = tree.leaves(lat, lon), inside_edges(lat, lon, edges), 0
    for leaf in range(len(tree.starts)):
        mine = leaves == leaf
        part = edges_for(edges, tree.bounds(leaf))
        sent += len(part)
        assert (inside_edges(lat[mine], lon[mine], part) == want[mine]).all()
    assert want.any() and not want.all() and sent < 4 * len(edges)


def test_quadtree_and_rtree():
    r = np.random.default_rng(1)
    lat, lon = 51 + r.random(5000), 7 + r.random(5000)
    q = Quadtree((51, 7, 52, 8), 8, lat, lon, 100)
    assert np.bincount(q.leaves(lat, lon)).max() <= 100
    box = (51.2, 7.3, 51.4, 7.5)
    inside = (lat >= box[0]) & (lat <= box[2]) & (lon >= box[1]) & (lon <= box[3])
    assert set(q.leaves(lat[inside], lon[inside])) <= set(q.leaves_of_box(*box))
    _, p = RTree(lon, lat).query(*[np.array([v]) for v in (7.3, 51.2, 7.5, 51.4)])
    assert sorted(p) == sorted(np.flatnonzero(inside))


def test_expressions(spark):
    rings = F.array(*[F.array(*[F.array(*map(F.lit, c)) for c in ring]) for ring in (SQUARE, HOLE)])
    x = spark.createDataFrame([(51.01, 7.01), (51.05, 7.05), (52.0, 7.0), (None, 7.0)], "lat double, lon double").select(geo.within(F.col("lat"), F.col("lon"), rings).alias("w"), geo.haversine(F.col("lat"), F.col("lon"), F.lit(51.01), F.lit(7.01)).alias("m"))
    assert [r["w"] for r in x.collect()] == [True, False, False, False]
    assert x.first()["m"] == 0
    w = spark.range(1).select(geo.wkt(F.lit("Polygon"), F.lit(None), F.lit(None), rings).alias("p"), geo.wkt(F.lit("Point"), F.lit(7.5), F.lit(51.5), rings).alias("q"), geo.wkt(F.lit("Curve"), F.lit(7.5), F.lit(51.5), rings).alias("e")).first()
    assert w["p"].startswith("POLYGON((7.0 51.0, 7.1 51.0,") and w["q"] == "POINT(7.5 51.5)" and w["e"] == "GEOMETRYCOLLECTION EMPTY"


def test_near_join_against_brute_force(spark):
    data = [d for d in points(800, 4) if None not in d]
    a = spark.createDataFrame(data[:100], "aid string, alat double, alon double")
    b = spark.createDataFrame([*data, ("null", None, None)], "bid string, lat double, lon double")
    got = geo.near_join(a, b, 150.0, ("alat", "alon"), ("lat", "lon")).count()
    lat, lon = np.array([d[1] for d in data]), np.array([d[2] for d in data])
    assert got == sum((great_circle_m(d[1], d[2], lat, lon) <= 150.0).sum() for d in data[:100])
