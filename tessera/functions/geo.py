"""Spherical distance, containment and text forms of geometry, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
M_PER_DEGREE = 111_195.08


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of the mean earth radius; null if a coordinate is null."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive bounding box (least latitude, greatest latitude, least longitude, greatest longitude)."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def within(lat: Column, lon: Column, rings: Column) -> Column:
    """Even-odd rule over all rings of (lon, lat); holes are rings too. Null geometry or position is not within."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)

        def crosses(i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
            ya, yb = a[1], b[1]
            return ((ya > lat) != (yb > lat)) & (lon < a[0] + (lat - ya) * (b[0] - a[0]) / F.nullif(yb - ya, F.lit(0.0)))

        return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses))

    total = F.aggregate(F.filter(rings, lambda r: F.size(r) > 2), F.lit(0), lambda acc, r: acc + crossings(r))
    return F.coalesce(total % 2 == 1, F.lit(False))


def _point(c: Column) -> Column:
    return F.concat_ws(" ", c[0], c[1])


def wkt(kind: Column, lon: Column, lat: Column, rings: Column) -> Column:
    """WKT of a point, line (first ring) or polygon; anything else is an empty collection."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, _point), ", "), F.lit(")"))
    return (
        F.when(kind == "Point", F.concat(F.lit("POINT("), F.concat_ws(" ", lon, lat), F.lit(")")))
        .when(kind == "LineString", F.concat(F.lit("LINESTRING"), ring(F.get(rings, F.lit(0)))))
        .when(kind == "Polygon", F.concat(F.lit("POLYGON("), F.array_join(F.transform(rings, ring), ", "), F.lit(")")))
        .when(kind == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON("), F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), ring(r), F.lit(")"))), ", "), F.lit(")")))
        .otherwise("GEOMETRYCOLLECTION EMPTY")
    )


def geometry(lon: Column, lat: Column, rings: Column) -> Column:
    """GeoJSON of a node's geometry as JSON text: a polygon of its rings, a line of one open ring, else a point; null without any."""
    ring = F.get(rings, F.lit(0))
    closed = F.get(ring, F.lit(0)) == F.element_at(ring, -1)
    shape = lambda kind, c: F.to_json(F.struct(F.lit(kind).alias("type"), c.alias("coordinates")))
    return (
        F.when((F.size(rings) > 1) | closed, shape("Polygon", rings))
        .when(F.size(rings) == 1, shape("LineString", ring))
        .when(lon.isNotNull() & lat.isNotNull(), shape("Point", F.array(lon, lat)))
    )


def feature(lon: Column, lat: Column, rings: Column, **properties: Column) -> Column:
    """A GeoJSON feature as JSON text."""
    p = F.to_json(F.struct(*[c.alias(k) for k, c in properties.items()]), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry(lon, lat, rings), F.lit(',"properties":'), p, F.lit("}"))


def near_join(anchors: DataFrame, others: DataFrame, radius_m: float, anchor: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Pairs within ``radius_m``: grid cells of that size, the anchors in nine cells, then the exact distance ``dist_m``.

    Column names of both sides must differ. Rows without position drop out.
    """
    lat_step = radius_m / M_PER_DEGREE * 1.0001

    def cell(lat: Column, lon: Column, dy: int = 0, dx: int = 0) -> Column:
        row = F.floor(lat / lat_step) + dy
        # All of a row of cells has the width of its widest latitude, so neighbours line up.
        width = lat_step / F.greatest(F.cos(F.radians(F.greatest(F.abs(row * lat_step), F.abs((row + 1) * lat_step)))), F.lit(0.01))
        return F.struct(row.alias("row"), (F.floor(lon / width) + dx).alias("column"))

    a_lat, a_lon, b_lat, b_lon = F.col(anchor[0]), F.col(anchor[1]), F.col(other[0]), F.col(other[1])
    cells = F.array_distinct(F.array(*[cell(a_lat, a_lon, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    a = anchors.filter(a_lat.isNotNull() & a_lon.isNotNull()).withColumn("__cell", F.explode(cells))
    b = others.filter(b_lat.isNotNull() & b_lon.isNotNull()).withColumn("__cell", cell(b_lat, b_lon))
    return a.join(b, "__cell").drop("__cell").withColumn("dist_m", haversine(a_lat, a_lon, b_lat, b_lon)).filter(F.col("dist_m") <= radius_m)
