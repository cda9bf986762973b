"""Points near other points, and the regions containing them.

A bounded sample of the positions shapes a quadtree; its leaves are ranges of Morton codes, so a
position finds its leaf by binary search. A position is replicated to the at most four leaves that
its search box touches (all of them around a pole, and across the 180th meridian), a region to the leaves
its bounding box touches, cut to what a leaf needs of it. A leaf that can't be divided further is probed in shares. Each leaf bulk-loads an
R-tree (sort-tile-recursive) over its positions and probes it; candidates are refined exactly
(great-circle distance, even-odd rule over all rings). A pair is reported only by the leaf that
holds its first position, its reference point, so no pair comes out twice.

Only distinct positions enter the tree; rows on one spot come back by a join, so a crowded spot
is one entry however many rows it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import load, materialise

EARTH_M = 6_371_008.8
POLAR = 89.9  # latitude from which on a search box goes around the pole
SAMPLE_ROWS = 400_000  # positions that shape the tree, at most (about): sent to the driver
SAMPLE_SHARE = 0.02  # of the positions, but 40,000 at least
LEAF_ROWS = 20_000
LEAF_SAMPLE = 16  # sampled positions a leaf stands for, at least
TEST_CELLS = 4_000_000  # positions times edges compared at a time
MAX_DEPTH = 16
FAN_OUT = 16


def morton(ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
    """Interleaved bits of two cell numbers below 2**16."""

    def spread(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.uint64)
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = (v | (v << np.uint64(shift))) & np.uint64(mask)
        return v

    return (spread(ix) | (spread(iy) << np.uint64(1))).astype(np.int64)


class Quadtree:
    """Leaves as sorted Morton ranges over a box; small and picklable."""

    def __init__(self, box: tuple[float, float, float, float], depth: int, lat: np.ndarray, lon: np.ndarray, capacity: float):
        self.lat0, self.lon0, self.lat1, self.lon1 = box
        self.depth = depth
        codes = np.sort(self.codes(lat, lon))
        starts, stack = [], [(0, 0)]
        while stack:
            start, level = stack.pop()
            span = 1 << (2 * (depth - level))
            if level < depth and np.searchsorted(codes, start + span) - np.searchsorted(codes, start) > capacity:
                stack += [(start + k * (span // 4), level + 1) for k in (3, 2, 1, 0)]
            else:
                starts.append(start)
        self.starts = np.array(starts, dtype=np.int64)
        # Leaves too full at the greatest depth are probed by several tasks, each with a share of the positions.
        held = np.diff(np.append(np.searchsorted(codes, self.starts), len(codes)))
        self.shares = np.maximum(1, np.ceil(held / max(capacity, 1e-9))).astype(np.int64) if len(codes) else np.ones(len(self.starts), np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.shares)[:-1]])  # number of a leaf's first group

    def bounds(self, leaf: int) -> tuple[float, float, float, float]:
        """Latitudes and longitudes of a leaf, a little widened."""
        start = int(self.starts[leaf])
        end = int(self.starts[leaf + 1]) if leaf + 1 < len(self.starts) else 1 << (2 * self.depth)
        side = int(round((end - start) ** 0.5))
        cx = sum(((start >> (2 * b)) & 1) << b for b in range(self.depth))
        cy = sum(((start >> (2 * b + 1)) & 1) << b for b in range(self.depth))
        h, w = (self.lat1 - self.lat0) / (1 << self.depth), (self.lon1 - self.lon0) / (1 << self.depth)
        return self.lat0 + cy * h - 1e-9, self.lon0 + cx * w - 1e-9, self.lat0 + (cy + side) * h + 1e-9, self.lon0 + (cx + side) * w + 1e-9

    def cells(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = 1 << self.depth
        at = lambda v, lo, hi: np.clip(((v - lo) / (hi - lo) * n).astype(np.int64), 0, n - 1)
        return at(lon, self.lon0, self.lon1), at(lat, self.lat0, self.lat1)

    def codes(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return morton(*self.cells(lat, lon))

    def leaves(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.codes(lat, lon), side="right") - 1

    def leaves_of_box(self, lat0: float, lon0: float, lat1: float, lon1: float) -> list[int]:
        """Leaves that a box touches: descends from the root."""
        (x0, x1), (y0, y1) = self.cells(np.array([lat0, lat1]), np.array([lon0, lon1]))
        out, stack = [], [(0, 0, 0, 0)]
        while stack:
            start, level, cx, cy = stack.pop()
            side = 1 << (self.depth - level)
            if cx > x1 or cy > y1 or cx + side <= x0 or cy + side <= y0:
                continue
            i = int(np.searchsorted(self.starts, start, side="right")) - 1
            end = int(self.starts[i + 1]) if i + 1 < len(self.starts) else 1 << (2 * self.depth)
            if end - int(self.starts[i]) >= side * side:
                out.append(i)
                continue
            half, quarter = side // 2, side * side // 4
            stack += [(start + k * quarter, level + 1, cx + (k & 1) * half, cy + (k >> 1) * half) for k in range(4)]
        return sorted(set(out))


class RTree:
    """Sort-tile-recursive R-tree over points; queries are answered level by level for all boxes at once."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n = len(x)
        strip = max(1, int(np.ceil(np.sqrt(np.ceil(n / FAN_OUT)))) * FAN_OUT)
        by_x = np.argsort(x, kind="stable")
        strips = np.empty(n, np.int64)
        strips[by_x] = np.arange(n) // strip
        self.order = np.lexsort((y, strips))
        px, py = x[self.order], y[self.order]
        self.levels = [(px, py, px, py)]
        while len(self.levels[-1][0]) > FAN_OUT:
            a, b, c, d = self.levels[-1]
            at = np.arange(0, len(a), FAN_OUT)
            self.levels.append((np.minimum.reduceat(a, at), np.minimum.reduceat(b, at), np.maximum.reduceat(c, at), np.maximum.reduceat(d, at)))

    def query(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, point number) of every point in every box."""
        n_top = len(self.levels[-1][0])
        q, node = np.repeat(np.arange(len(x0)), n_top), np.tile(np.arange(n_top), len(x0))
        for depth in range(len(self.levels) - 1, -1, -1):
            a, b, c, d = self.levels[depth]
            hit = (a[node] <= x1[q]) & (c[node] >= x0[q]) & (b[node] <= y1[q]) & (d[node] >= y0[q])
            q, node = q[hit], node[hit]
            if depth:
                q = np.repeat(q, FAN_OUT)
                node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                there = node < len(self.levels[depth - 1][0])
                q, node = q[there], node[there]
        return q, self.order[node]


def great_circle_m(lat1, lon1, lat2, lon2):
    """Haversine distance in metres, numpy."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(h)))


def edges_of(rings: list) -> np.ndarray:
    """Edges (x0, y0, x1, y1, ring) of closed rings; rings of fewer than three points have none."""
    out = []
    for k, ring in enumerate(rings):
        if ring is not None and len(ring) >= 3:
            xy = np.array([c[:2] for c in ring], dtype=float)
            out.append(np.column_stack([xy, np.roll(xy, -1, axis=0), np.full(len(xy), k)]))
    return np.vstack(out) if out else np.empty((0, 5))


def edges_for(edges: np.ndarray, bounds: tuple[float, float, float, float]) -> np.ndarray:
    """What of a region's edges decides, by the even-odd rule along a ray to the east, about positions within bounds.

    Edges west of, above and below the bounds never meet such a ray. Edges east of them meet it whatever the position's
    longitude, so each run of them counts like one edge between its ends' latitudes.
    """
    lat0, lon0, lat1, lon1 = bounds
    x0, y0, x1, y1, ring = edges.T
    east = np.minimum(x0, x1) > lon1
    here = ~east & (np.maximum(x0, x1) >= lon0)
    if east.any():
        new = east & np.append(True, ~east[:-1] | (ring[1:] != ring[:-1]))
        last = east & np.append(~east[1:] | (ring[1:] != ring[:-1]), True)
        a, b = y0[new], y1[last]
        x = np.full(len(a), lon1 + 1.0)
        runs = np.column_stack([x, a, x, b, ring[new]])
        edges = np.vstack([edges[here], runs])
    else:
        edges = edges[here]
    low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
    return edges[(high >= lat0) & (low <= lat1) & (high > low)]


def inside_edges(lat: np.ndarray, lon: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even-odd rule over edges."""
    odd = np.zeros(len(lat), dtype=bool)
    run = edges[:, 1] != edges[:, 3]
    x0, y0, x1, y1 = edges[run, :4].T
    if not len(x0):
        return odd
    slope = (x1 - x0) / (y1 - y0)
    step = max(1, TEST_CELLS // len(x0))
    for i in range(0, len(lat), step):
        la, lo = lat[i : i + step, None], lon[i : i + step, None]
        crosses = ((y0 > la) != (y1 > la)) & (lo < x0 + (la - y0) * slope)
        odd[i : i + step] = crosses.sum(axis=1) % 2 == 1
    return odd


def inside_rings(lat: np.ndarray, lon: np.ndarray, rings: list) -> np.ndarray:
    """Even-odd rule over all rings, each of (lon, lat); rings may run either way."""
    return inside_edges(lat, lon, edges_of(rings))


def _margins(lat: np.ndarray, radius_m: float) -> tuple[float, np.ndarray]:
    """Half the search box of each position, in degrees; around a pole it goes around the globe."""
    dlat = np.degrees(radius_m / EARTH_M) * (1 + 1e-9) + 1e-9
    most = np.abs(lat) + dlat
    return dlat, np.where(most >= POLAR, 360.0, dlat / np.cos(np.radians(np.minimum(most, POLAR))))


OUT = "kind string, a_lat double, a_lon double, b_lat double, b_lon double, area string"


def join_leaf(points: pd.DataFrame, areas: pd.DataFrame, radius_m: float) -> pd.DataFrame:
    """Near pairs whose first position is at home in this leaf, and the home positions of each region.

    ``x`` is the longitude to search by, beyond 180 degrees for copies from across the meridian.
    """
    lat, lon, x, home = (points[c].to_numpy() for c in ("lat", "lon", "x", "home"))
    parts = []
    if len(lat):
        tree = RTree(x, lat)
        if radius_m > 0:
            dlat, dlon = _margins(lat, radius_m)
            mine = np.flatnonzero(home)
            for i in range(0, len(mine), 4096):
                m = mine[i : i + 4096]
                q, p = tree.query(x[m] - dlon[m], lat[m] - dlat, x[m] + dlon[m], lat[m] + dlat)
                q = m[q]
                later = (lat[q] < lat[p]) | ((lat[q] == lat[p]) & (lon[q] < lon[p]))
                q, p = q[later], p[later]
                near = great_circle_m(lat[q], lon[q], lat[p], lon[p]) <= radius_m
                q, p = q[near], p[near]
                parts.append(pd.DataFrame({"kind": "near", "a_lat": lat[q], "a_lon": lon[q], "b_lat": lat[p], "b_lon": lon[p], "area": None}))
        for area, flat in zip(areas["area"], areas["edges"], strict=True):
            edges = np.array(flat, dtype=float).reshape(-1, 5)
            low, high = edges[:, 1:4:2].min(), edges[:, 1:4:2].max()
            # Nothing lies east of all edges, nor above or below them.
            _, p = tree.query(np.array([-np.inf]), np.array([low]), np.array([edges[:, 0:3:2].max()]), np.array([high]))
            p = p[home[p]]
            p = p[inside_edges(lat[p], lon[p], edges)]
            if len(p):
                parts.append(pd.DataFrame({"kind": "inside", "a_lat": lat[p], "a_lon": lon[p], "b_lat": np.nan, "b_lon": np.nan, "area": area}))
    empty = pd.DataFrame({"kind": pd.Series(dtype=str), **{c: pd.Series(dtype=float) for c in ("a_lat", "a_lon", "b_lat", "b_lon")}, "area": pd.Series(dtype=str)})
    return pd.concat(parts, ignore_index=True) if parts else empty


def spatial_pairs(positions: DataFrame, areas: DataFrame, radius_m: float, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Pairs of distinct positions within ``radius_m``, and positions inside areas.

    ``positions``: ``lat, lon`` double, distinct, not null. ``areas``: ``area string, rings
    array<array<array<double>>>`` (lon, lat). Columns of the result: ``OUT``; of a near pair the
    first position is the smaller by (lat, lon). Empty tables give an empty result.
    """
    spark = positions.sparkSession
    stats = positions.agg(F.count(F.lit(1)).alias("n"), F.min("lat"), F.min("lon"), F.max("lat"), F.max("lon")).first()
    n = stats["n"]
    if not n:
        return spark.createDataFrame([], OUT)
    box = (stats[1], stats[2], stats[3] + 1e-6, stats[4] + 1e-6)
    share = min(1.0, min(sample_rows, max(40_000, n * SAMPLE_SHARE)) / n)
    # Chosen by hash: the same sample however often a stage is run.
    sample = positions.filter(F.pmod(F.xxhash64("lat", "lon"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("lat", "lon").toPandas()
    dlat, dlon = _margins(np.array([min(max(abs(box[0]), abs(box[2])), POLAR - 1)]), max(radius_m, 1e-3))
    depth = int(np.clip(np.floor(np.log2(min((box[2] - box[0]) / (2 * dlat), (box[3] - box[1]) / (2 * dlon[0])))), 0, MAX_DEPTH))
    rows = float(max(np.clip(n / 48, 2_000, leaf_rows), LEAF_SAMPLE * n / max(len(sample), 1) if share < 1 else 0))
    tree = Quadtree(box, depth, sample["lat"].to_numpy(), sample["lon"].to_numpy(), rows * len(sample) / n)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lat, lon = b["lat"].to_numpy(), b["lon"].to_numpy()
            dy, dx = _margins(lat, radius_m)
            own = tree.leaves(lat, lon)
            found = np.stack([own, *[tree.leaves(lat + sy * dy, lon + sx * dx) for sy in (-1, 1) for sx in (-1, 1)]])
            first = np.ones(found.shape, dtype=bool)
            for i in range(1, 5):
                first[i] = (found[i] != found[:i]).all(axis=0)
            k, i = np.nonzero(first)
            leaf, at, x, home = [found[k, i]], [i], [lon[i]], [k == 0]
            # Around a pole, and across the 180th meridian: each leaf its box touches there.
            for j in np.flatnonzero(dx >= 360.0):
                there = np.array([v for v in tree.leaves_of_box(lat[j] - dy, -180.0, lat[j] + dy, 180.0) if v not in found[:, j]], dtype=np.int64)
                leaf, at, x, home = [*leaf, there], [*at, np.full(len(there), j)], [*x, np.full(len(there), lon[j])], [*home, np.zeros(len(there), bool)]
            for turn, over in ((360.0, lon - dx < -180.0), (-360.0, lon + dx > 180.0)):
                for j in np.flatnonzero(over & (dx < 360.0)):
                    there = np.array(tree.leaves_of_box(lat[j] - dy, lon[j] + turn - dx[j], lat[j] + dy, lon[j] + turn + dx[j]), dtype=np.int64)
                    leaf, at, x, home = [*leaf, there], [*at, np.full(len(there), j)], [*x, np.full(len(there), lon[j] + turn)], [*home, np.zeros(len(there), bool)]
            leaf, at, x, home = (np.concatenate(v) for v in (leaf, at, x, home))
            # Each share of a leaf has all its positions, and is home to those of a hash.
            n_shares = tree.shares[leaf]
            row = np.repeat(np.arange(len(leaf)), n_shares)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(n_shares) - n_shares, n_shares)
            mine = (np.abs(lat[at] * 1e7).astype(np.int64) * 31 + np.abs(lon[at] * 1e7).astype(np.int64)) % n_shares
            yield pd.DataFrame({"leaf": tree.first[leaf[row]] + turn, "lat": lat[at[row]], "lon": lon[at[row]], "x": x[row], "home": home[row] & (mine[row] == turn)})

    def assign_areas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for area, rings in zip(b["area"], b["rings"], strict=True):
                edges = edges_of(rings)
                if not len(edges):
                    continue
                for leaf in tree.leaves_of_box(edges[:, 1].min(), edges[:, 0].min(), edges[:, 1].max(), edges[:, 0].max()):
                    part = edges_for(edges, tree.bounds(leaf))
                    if len(part):
                        rows += [(tree.first[leaf] + k, area, part.ravel()) for k in range(tree.shares[leaf])]
                    if len(rows) >= 1000:
                        yield pd.DataFrame(rows, columns=["leaf", "area", "edges"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["leaf", "area", "edges"])

    def one(points: pd.DataFrame, regions: pd.DataFrame) -> pd.DataFrame:
        return join_leaf(points, regions, radius_m)

    p = positions.select("lat", "lon").mapInPandas(assign, "leaf long, lat double, lon double, x double, home boolean")
    a = areas.select("area", "rings").filter("rings is not null").mapInPandas(assign_areas, "leaf long, area string, edges array<double>")
    return p.groupBy("leaf").cogroup(a.groupBy("leaf")).applyInPandas(one, OUT)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def near_and_inside(elements: DataFrame, areas: DataFrame, radius_m: float) -> DataFrame:
    """``kind, a_id, b_id``: near pairs of different ids, and (area, id) of every id inside an area.

    ``elements``: ``id, lat, lon``; rows without id or position take no part, an id may have several
    positions. ``areas``: ``area, rings``. Repeated rows of either table change nothing. Every result row is distinct.
    """
    spots = materialise(elements.filter("id is not null and lat is not null and lon is not null").select("id", "lat", "lon").distinct(), "spots")
    pairs = materialise(spatial_pairs(spots.select("lat", "lon").distinct(), areas.dropDuplicates(["area", "rings"]), radius_m), "pairs")
    a, b = spots.select(F.col("id").alias("x"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")), spots.select(F.col("id").alias("y"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    near = pairs.filter("kind = 'near'").join(a, ["a_lat", "a_lon"]).join(b, ["b_lat", "b_lon"]).select("x", "y")
    here = a.join(b, [F.col("a_lat") == F.col("b_lat"), F.col("a_lon") == F.col("b_lon"), F.col("x") < F.col("y")]).select("x", "y")
    both = near.unionByName(here).filter("x <> y").select(F.lit("near").alias("kind"), F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))
    within = pairs.filter("kind = 'inside'").join(a, ["a_lat", "a_lon"]).select(F.lit("inside").alias("kind"), F.col("area").alias("a_id"), F.col("x").alias("b_id"))
    return both.unionByName(within).distinct()


def element_positions(overpass: DataFrame) -> DataFrame:
    """``id, lat, lon`` of OSM elements within 50-53 N, 5-10 E: the element's own position, else its centre."""
    lat, lon = F.coalesce(finite(F.col("lat")), finite(F.col("center.lat"))), F.coalesce(finite(F.col("lon")), finite(F.col("center.lon")))
    return overpass.select(F.col("source_id").alias("id"), lat.alias("lat"), lon.alias("lon")).filter(F.col("lat").between(50, 53) & F.col("lon").between(5, 10))


def area_rings(geo_areas: DataFrame, dataset: str) -> DataFrame:
    return geo_areas.filter(F.col("dataset") == dataset).select(F.col("source_id").alias("area"), F.col("record.geografische_polygone.geometry.coordinates").alias("rings")).filter("area is not null")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_and_inside(element_positions(load(spark, sf_dir, "overpass")), area_rings(load(spark, sf_dir, "geo_areas"), "stat_bezirke"), 20.0)


FOUND_SQL = """
WITH p AS (
  SELECT DISTINCT source_id AS id, coalesce(lat, center.lat) AS lat, coalesce(lon, center.lon) AS lon FROM overpass
  WHERE coalesce(lat, center.lat) BETWEEN 50 AND 53 AND coalesce(lon, center.lon) BETWEEN 5 AND 10 AND source_id IS NOT NULL
), c AS (SELECT *, floor(lat / 0.0002)::BIGINT AS cy, floor(lon / 0.0004)::BIGINT AS cx FROM p),
o AS (SELECT unnest([-1, 0, 1]) AS dy), o2 AS (SELECT unnest([-1, 0, 1]) AS dx),
near AS (
  SELECT DISTINCT 'near' AS kind, a.id AS a_id, b.id AS b_id
  FROM (SELECT c.*, cy + dy AS ny, cx + dx AS nx FROM c, o, o2) a JOIN c b ON a.ny = b.cy AND a.nx = b.cx AND a.id < b.id
  WHERE 2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 20
), ar AS (
  SELECT DISTINCT source_id AS area, record.geografische_polygone.geometry.coordinates AS rings FROM geo_areas WHERE dataset = 'stat_bezirke'
), rr AS (SELECT area, unnest(rings) AS ring, row_number() OVER () AS rid FROM ar),
e AS (
  SELECT area, x0, y0, x1, y1 FROM (
    SELECT area, unnest(list_transform(range(1, len(ring) + 1), lambda i: {x0: ring[i][1], y0: ring[i][2], x1: ring[(i % len(ring)) + 1][1], y1: ring[(i % len(ring)) + 1][2]}), recursive := true) FROM rr)
  WHERE y0 <> y1
), bb AS (SELECT area, min(least(x0, x1)) AS bx0, max(greatest(x0, x1)) AS bx1, min(least(y0, y1)) AS by0, max(greatest(y0, y1)) AS by1 FROM e GROUP BY area),
cand AS (SELECT area, id, lat, lon FROM bb JOIN p ON lat BETWEEN by0 AND by1 AND lon BETWEEN bx0 AND bx1),
hit AS (
  SELECT area, id, lat, lon, count(*) AS n FROM cand JOIN e USING (area)
  WHERE ((y0 > lat) <> (y1 > lat)) AND lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0) GROUP BY ALL
)
SELECT * FROM near UNION ALL SELECT DISTINCT 'inside', area, id FROM hit WHERE n % 2 = 1
"""
