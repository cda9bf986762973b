"""Queries on space, hierarchy and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo, text
from tessera.functions.temporal import starts_near, valid_at
from tessera.graph import top_per
from tessera.operators import linking
from tessera.plans import world as w
from tessera.sources import feeds, places

QUERIES: dict = {}
SQL: dict = {}
C = F.col
def now() -> Column:
    return F.lit("2026-01-01T00:00:00Z").cast("timestamp")



def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("haversine", f"WITH {w.ODS} SELECT id, round({w.HAVERSINE.format(lat1='lat', lon1='lon', lat2='51.5136', lon2='7.4653')}, 3) AS dist_m FROM ods WHERE lat IS NOT NULL AND lon IS NOT NULL")
def haversine(s: SparkSession, d: str) -> DataFrame:
    m = geo.haversine(C("lat"), C("lon"), F.lit(feeds.HOME_LAT), F.lit(feeds.HOME_LON))
    return w.pois(s, d).filter("lat is not null and lon is not null").select("id", F.round(m, 3).alias("dist_m"))


@query("bbox_filter", f"WITH {w.OSM} SELECT id, label FROM osm WHERE lat BETWEEN 51.41 AND 51.60 AND lon BETWEEN 7.30 AND 7.64")
def bbox_filter(s: SparkSession, d: str) -> DataFrame:
    return w.osm(s, d).filter(geo.in_box(C("lat"), C("lon"), feeds.BOX)).select("id", "label")


# The rings' edges, and each position's crossings by area.
EDGE_CTE = """rr AS (SELECT id AS area, area_type, unnest(rings) AS ring FROM areas),
seg AS (SELECT area, area_type, u.x0 AS x0, u.y0 AS y0, u.x1 AS x1, u.y1 AS y1 FROM (
  SELECT area, area_type, unnest(list_transform(range(1, len(ring) + 1), lambda i: {x0: ring[i][1], y0: ring[i][2], x1: ring[(i % len(ring)) + 1][1], y1: ring[(i % len(ring)) + 1][2]})) AS u FROM rr WHERE len(ring) > 2)),
bb AS (SELECT area, area_type, min(least(x0, x1)) AS bx0, max(greatest(x0, x1)) AS bx1, min(least(y0, y1)) AS by0, max(greatest(y0, y1)) AS by1 FROM seg GROUP BY ALL)"""


def inside_sql(points: str) -> str:
    return f"""{EDGE_CTE},
cand AS (SELECT area, area_type, id, lat, lon FROM bb JOIN (SELECT id, lat, lon FROM {points}) ON lat BETWEEN by0 AND by1 AND lon BETWEEN bx0 AND bx1),
hit AS (SELECT c.area, c.area_type, c.id, c.lat, c.lon, count(*) AS n FROM cand c JOIN seg ON seg.area = c.area WHERE (y0 > lat) <> (y1 > lat) AND lon < x0 + (lat - y0) * (x1 - x0) / (y1 - y0) GROUP BY ALL),
inside AS (SELECT area, area_type, id FROM hit WHERE n % 2 = 1)"""


@query("point_in_polygon", f"WITH {w.ODS}, {w.AREAS}, {inside_sql('ods')} SELECT id AS from_node_id, area AS to_node_id FROM inside WHERE area_type = 'stadtbezirk'")
def point_in_polygon(s: SparkSession, d: str) -> DataFrame:
    """By the ray-casting expression: districts meet positions by the grid cells of their boxes."""
    a = w.areas(s, d).filter(F.get_json_object("properties", "$.area_type") == "stadtbezirk")
    step = 0.05
    xs, ys = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[0]))), F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[1])))
    cell = lambda v: F.floor(v / step).cast("int")
    a = a.select(C("id").alias("to_node_id"), "rings", F.explode(F.sequence(cell(F.array_min(xs)), cell(F.array_max(xs)))).alias("cx"), ys.alias("ys")).select("to_node_id", "rings", "cx", F.explode(F.sequence(cell(F.array_min("ys")), cell(F.array_max("ys")))).alias("cy"))
    p = w.pois(s, d).filter("lat is not null and lon is not null").select(C("id").alias("from_node_id"), "lat", "lon", cell(C("lon")).alias("cx"), cell(C("lat")).alias("cy"))
    return p.join(a, ["cx", "cy"]).filter(geo.within(C("lat"), C("lon"), C("rings"))).select("from_node_id", "to_node_id")


@query("located_in_edges", f"""WITH {w.OSM}, {w.AREAS}, {w.EDGES_SQL}, {inside_sql('osm')}
SELECT id AS from_node_id, area AS to_node_id FROM inside i WHERE area_type = 'statistischer_bezirk'
  AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.from_node_id = i.id AND e.to_node_id = i.area AND e.edge_type = 'LOCATED_IN' AND e.to_s IS NULL)""")
def located_in_edges(s: SparkSession, d: str) -> DataFrame:
    a = w.areas(s, d).filter(F.get_json_object("properties", "$.area_type") == "statistischer_bezirk")
    return linking.located_in(w.osm(s, d), a, w.edges(s, d), "POI", "osm_overpass")


NEAR = f"""anchors AS (SELECT id, lat, lon, observed_s FROM traffic WHERE lat IS NOT NULL AND lon IS NOT NULL ORDER BY observed_s DESC, id LIMIT 50),
pos AS (SELECT id, lat, lon, observed_s FROM osm UNION ALL SELECT id, lat, lon, observed_s FROM ods UNION ALL SELECT id, lat, lon, observed_s FROM traffic),
near AS (SELECT a.id AS anchor_id, p.id AS other_id, {w.metres('a', 'p')} AS m, a.observed_s AS a_s, p.observed_s AS p_s FROM anchors a JOIN pos p ON a.id <> p.id AND abs(a.lat - p.lat) < 0.03 AND abs(a.lon - p.lon) < 0.06)"""


def _anchors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cols = ["id", "lat", "lon", "observed_at"]
    n = w.osm(s, d).select(*cols).unionByName(w.pois(s, d).select(*cols)).unionByName(w.traffic(s, d).select(*cols))
    a = w.traffic(s, d).filter("lat is not null and lon is not null").orderBy(F.desc("observed_at"), "id").limit(50)
    return a.select(C("id").alias("anchor_id"), C("lat").alias("a_lat"), C("lon").alias("a_lon"), C("observed_at").alias("a_at")), n.select(C("id").alias("other_id"), "lat", "lon", C("observed_at").alias("o_at"))


@query("spatial_temporal_neighbours", f"WITH {w.OSM}, {w.ODS}, {w.TRAFFIC}, {NEAR} SELECT anchor_id, other_id, round(m, 3) AS dist_m FROM near WHERE m <= 1500 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY m, other_id) <= 25")
def spatial_temporal_neighbours(s: SparkSession, d: str) -> DataFrame:
    a, o = _anchors(s, d)
    near = geo.near_join(a, o, 1500.0, ("a_lat", "a_lon"), ("lat", "lon")).filter("anchor_id <> other_id")
    return top_per(near, ["anchor_id"], [C("dist_m"), C("other_id")], 25).select("anchor_id", "other_id", F.round("dist_m", 3).alias("dist_m"))


@query("temporal_overlap", f"WITH {w.OSM}, {w.ODS}, {w.TRAFFIC}, {NEAR} SELECT anchor_id, other_id FROM near WHERE m <= 1500 AND p_s BETWEEN a_s - 2592000 AND a_s + 2592000")
def temporal_overlap(s: SparkSession, d: str) -> DataFrame:
    a, o = _anchors(s, d)
    near = geo.near_join(a, o, 1500.0, ("a_lat", "a_lon"), ("lat", "lon")).filter("anchor_id <> other_id")
    return near.filter(starts_near(C("o_at"), C("a_at"), F.lit(None).cast("timestamp"), 30)).select("anchor_id", "other_id")


@query("geojson_to_wkt", f"""WITH {w.AREAS} SELECT id, 'POLYGON(' || array_to_string(list_transform(rings, lambda r: '(' || array_to_string(list_transform(r, lambda p: p[1]::VARCHAR || ' ' || p[2]::VARCHAR), ', ') || ')'), ', ') || ')' AS wkt FROM areas WHERE rings IS NOT NULL""")
def geojson_to_wkt(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return w.areas(s, d).filter("rings is not null").select("id", geo.wkt(F.lit("Polygon"), none, none, C("rings")).alias("wkt"))


@query("hierarchy_link", f"WITH {w.AREAS} SELECT c.id AS from_node_id, p.id AS to_node_id FROM areas c JOIN areas p ON c.parent = p.source_id AND p.area_type = 'stadtbezirk' WHERE c.area_type = 'statistischer_bezirk'")
def hierarchy_link(s: SparkSession, d: str) -> DataFrame:
    return places.area_hierarchy(w.areas(s, d), now()).select("from_node_id", "to_node_id")


@query("orphan_areas", f"WITH {w.AREAS} SELECT c.id, c.parent AS parent_key FROM areas c WHERE c.parent IS NOT NULL AND c.parent NOT IN (SELECT source_id FROM areas WHERE area_type = 'stadtbezirk')")
def orphan_areas(s: SparkSession, d: str) -> DataFrame:
    a = w.areas(s, d).withColumn("kind", F.get_json_object("properties", "$.area_type"))
    return linking.orphans(a.filter("kind = 'statistischer_bezirk'"), a.filter("kind = 'stadtbezirk'"), F.get_json_object("properties", "$._parent_source_id"), C("source_id"))


@query("part_of_by_name", f"""WITH {w.ODS}, {w.AREAS}, sub AS (SELECT id, lower(label) AS k FROM areas WHERE area_type = 'statistischer_bezirk'),
named AS (SELECT id, max(statbezibe) AS statbezibe FROM ods GROUP BY id)
SELECT DISTINCT named.id AS from_node_id, sub.id AS to_node_id FROM named JOIN sub ON lower(statbezibe) = k""")
def part_of_by_name(s: SparkSession, d: str) -> DataFrame:
    # Of several places with one key the greatest name counts, in SQL and here.
    p = w.pois_all(s, d).groupBy("id").agg(F.max(F.get_json_object("properties", "$.stat_bezirk")).alias("stat_bezirk")).withColumn("valid_to", F.lit(None).cast("timestamp"))
    a = w.areas(s, d).filter(F.get_json_object("properties", "$.area_type") == "statistischer_bezirk")
    return linking.part_of_by_name(p, a, w.edges(s, d), C("stat_bezirk"))


@query("part_of_by_key", f"WITH {w.TEXTS}, {w.AREAS} SELECT t.id AS from_node_id, a.id AS to_node_id FROM (SELECT sha256('documents|' || doc_id) AS id, area_nr FROM documents) t JOIN areas a ON a.source_id = t.area_nr AND a.area_type = 'statistischer_bezirk'")
def part_of_by_key(s: SparkSession, d: str) -> DataFrame:
    t = w.load(s, d, "documents").select(w.node_id(F.lit("documents"), C("doc_id").cast("string")).alias("id"), "area_nr", F.lit(None).cast("timestamp").alias("valid_to"))
    a = w.areas(s, d).filter(F.get_json_object("properties", "$.area_type") == "statistischer_bezirk")
    return linking.part_of_by_key(t, a, w.edges(s, d), C("area_nr"), C("source_id"))


@query("semi_join_chain", """SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7)))""")
def semi_join_chain(s: SparkSession, d: str) -> DataFrame:
    """Stops to stop times to trips to routes: here suppliers of a nation to lines to orders to customers."""
    stops = w.load(s, d, "supplier").filter("s_nationkey = 7").select(C("s_suppkey").alias("stop_id"))
    times = w.load(s, d, "lineitem").select(C("l_suppkey").alias("stop_id"), C("l_orderkey").alias("trip_id"))
    trips = w.load(s, d, "orders").select(C("o_orderkey").alias("trip_id"), C("o_custkey").alias("route_id"))
    routes = w.load(s, d, "customer").select(C("c_custkey").alias("route_id"), "c_name")
    return feeds.gtfs_routes(stops, times, trips, routes).select(C("route_id").alias("c_custkey"), "c_name")


NORM = r"trim(regexp_replace(replace(lower(coalesce({c}, '')), 'ß', 'ss'), '[\s\p{{Z}}]+', ' ', 'g'))"


@query("normalize_text", f"SELECT source_id, {NORM.format(c='objektname')} AS name, {NORM.format(c='strasse')} AS street FROM ods_pois")
def normalize_text(s: SparkSession, d: str) -> DataFrame:
    return w.load(s, d, "ods_pois").select("source_id", text.normalize(C("objektname")).alias("name"), text.normalize(C("strasse")).alias("street"))


GAZ = f"""layer AS (
  SELECT {NORM.format(c='label')} AS term, source_id AS node_id, 'mentions_area' AS relation, 0 AS l, source_id AS ord FROM areas WHERE area_type = 'stadtbezirk' UNION ALL
  SELECT {NORM.format(c='label')}, source_id, 'mentions_street', 1, source_id FROM areas WHERE area_type <> 'stadtbezirk'),
base AS (SELECT term, first(node_id ORDER BY ord) AS node_id, first(relation) AS relation FROM layer WHERE l = 0 AND length(term) >= 4 GROUP BY term),
top AS (SELECT term, last(node_id ORDER BY ord) AS node_id, first(relation) AS relation FROM layer WHERE l = 1 AND length(term) >= 4 GROUP BY term),
gaz AS (SELECT * FROM top UNION ALL SELECT * FROM base WHERE term NOT IN (SELECT term FROM top))"""


def _gazetteer(s: SparkSession, d: str) -> DataFrame:
    """Districts, and over them sub-districts in the part of streets; in the order of their numbers."""
    a = w.areas(s, d).withColumn("kind", F.get_json_object("properties", "$.area_type"))
    # Numbers have a fixed width here, so they order as integers too.
    row = lambda k: a.filter(C("kind") == k).select(F.conv(F.hex("source_id"), 16, 10).cast("decimal(38,0)").alias("ord"), C("source_id").alias("id"), "label")
    return text.gazetteer([(row("stadtbezirk"), "mentions_area"), (row("statistischer_bezirk"), "mentions_street")])


@query("gazetteer_layers", f"WITH {w.AREAS}, {GAZ} SELECT term, node_id, relation FROM gaz")
def gazetteer_layers(s: SparkSession, d: str) -> DataFrame:
    return _gazetteer(s, d)


def _mentions(s: SparkSession, d: str) -> DataFrame:
    t = w.load(s, d, "documents").select(C("doc_id").alias("id"), "text")
    return text.mentions(t, _gazetteer(s, d))


@query("find_mentions")
def find_mentions(s: SparkSession, d: str) -> DataFrame:
    return _mentions(s, d)


@query("link_confidence")
def link_confidence(s: SparkSession, d: str) -> DataFrame:
    return linking.link_confidence(_mentions(s, d)).filter(C("confidence") >= linking.FLOOR)


@query("text_links")
def text_links(s: SparkSession, d: str) -> DataFrame:
    """The whole linking pipeline on the graph's texts and areas."""
    return linking.text_links(w.texts(s, d), w.areas(s, d).filter(valid_at()))

