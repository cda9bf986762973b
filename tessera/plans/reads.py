"""Queries on nodes and edges: lists, history, neighbourhoods and subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.temporal import valid_at
from tessera.graph import top_per
from tessera.operators import candidates, history
from tessera.plans import world as w

QUERIES: dict = {}
SQL: dict = {}
C = F.col


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def secs(c: str):
    return F.unix_seconds(c)


AS_OF, AS_OF_S = "2024-07-01T00:00:00Z", 1719792000


@query("current_nodes", f"WITH {w.ALL_NODES} SELECT node_type, source, count(*) AS n, max(observed_s) AS newest_s FROM nodes GROUP BY ALL")
def current_nodes(s: SparkSession, d: str) -> DataFrame:
    return w.nodes(s, d).filter(valid_at()).groupBy("node_type", "source").agg(F.count(F.lit(1)).alias("n"), F.max(secs("observed_at")).alias("newest_s"))


@query("as_of_nodes", f"WITH {w.TEXTS} SELECT id, node_type, label, from_s FROM texts WHERE from_s IS NULL OR from_s <= {AS_OF_S}")
def as_of_nodes(s: SparkSession, d: str) -> DataFrame:
    return w.texts(s, d).filter(valid_at(AS_OF)).select("id", "node_type", "label", secs("valid_from").alias("from_s"))


@query("as_of_edges", f"WITH {w.EDGES_SQL} SELECT id, edge_type, from_s, to_s FROM edges WHERE from_s <= {AS_OF_S} AND (to_s IS NULL OR to_s > {AS_OF_S})")
def as_of_edges(s: SparkSession, d: str) -> DataFrame:
    return w.edges(s, d).filter(valid_at(AS_OF)).select("id", "edge_type", secs("valid_from").alias("from_s"), secs("valid_to").alias("to_s"))


@query("list_nodes_page", f"WITH {w.OSM} SELECT id, label, observed_s FROM osm ORDER BY observed_s DESC, id LIMIT 50 OFFSET 100")
def list_nodes_page(s: SparkSession, d: str) -> DataFrame:
    return w.Graph(w.osm(s, d), w.edges(s, d)).list_nodes("POI", limit=50, offset=100).select("id", "label", secs("observed_at").alias("observed_s"))


VERSIONS_SQL = """
o AS (SELECT _source.dwd_station_id AS station, received_at AS t0, max(coalesce(condition, '\x01null')) AS condition FROM brightsky WHERE _source.dwd_station_id IS NOT NULL AND received_at IS NOT NULL GROUP BY ALL),
n AS (SELECT *, CASE WHEN condition IS DISTINCT FROM lag(condition) OVER (PARTITION BY station ORDER BY t0) THEN 1 ELSE 0 END AS is_new FROM o),
v AS (SELECT station, nullif(condition, '\x01null') AS condition, t0 FROM n WHERE is_new = 1)"""


def weather_versions(s: SparkSession, d: str) -> DataFrame:
    b = w.load(s, d, "brightsky").select(C("_source.dwd_station_id").alias("station"), C("received_at").alias("effect"), C("received_at").alias("observed_at"), F.coalesce("condition", F.lit("\x01null")).alias("condition"), F.lit(None).cast("timestamp").alias("valid_to"))
    v = history.build(b.filter("station is not null and effect is not null"), ["station"], ["condition"])
    return v.withColumn("condition", F.nullif("condition", F.lit("\x01null")))


@query("version_chain", f"WITH {VERSIONS_SQL} SELECT station, condition, epoch_us(t0) // 1000000 AS start_s, epoch_us(lead(t0) OVER (PARTITION BY station ORDER BY t0)) // 1000000 AS end_s FROM v")
def version_chain(s: SparkSession, d: str) -> DataFrame:
    return weather_versions(s, d).select("station", "condition", secs("start").alias("start_s"), secs("end").alias("end_s"))


@query("node_history", f"WITH {VERSIONS_SQL}, k AS (SELECT min(station) AS station FROM v) SELECT station, condition, epoch_us(t0) // 1000000 AS start_s FROM v JOIN k USING (station)")
def node_history(s: SparkSession, d: str) -> DataFrame:
    v = weather_versions(s, d).select(F.lit("dwd").alias("source"), C("station").alias("source_id"), "condition", C("start").alias("valid_from"), C("start").alias("observed_at"))
    first = v.agg(F.min("source_id").alias("source_id"))
    x = w.Graph(v.join(F.broadcast(first), "source_id", "left_semi"), w.edges(s, d)).history("dwd")  # one row
    return x.select(C("source_id").alias("station"), "condition", secs("valid_from").alias("start_s"))


@query("json_path_filter", f"WITH {w.OSM} SELECT id, label, shop FROM osm WHERE shop IN ('bakery', 'books')")
def json_path_filter(s: SparkSession, d: str) -> DataFrame:
    shop = F.get_json_object("properties", "$.shop")
    return w.osm(s, d).withColumn("shop", shop).filter(C("shop").isin("bakery", "books")).select("id", "label", "shop")


BUSY = "SELECT to_node_id AS id FROM edges WHERE edge_type = 'LOCATED_IN' GROUP BY 1 HAVING count(*) >= 2"


def busy_areas(e: DataFrame) -> DataFrame:
    return e.filter("edge_type = 'LOCATED_IN'").groupBy(C("to_node_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("id")


@query("nodes_by_ids", f"WITH {w.EDGES_SQL}, {w.AREAS} SELECT id, label, area_type FROM areas WHERE id IN ({BUSY})")
def nodes_by_ids(s: SparkSession, d: str) -> DataFrame:
    g = w.Graph(w.areas(s, d), w.edges(s, d))
    return g.nodes_by_ids(busy_areas(g.edges)).select("id", "label", F.get_json_object("properties", "$.area_type").alias("area_type"))


@query("incident_edges", f"WITH {w.EDGES_SQL} SELECT id, edge_type, to_node_id FROM edges WHERE to_s IS NULL AND (to_node_id IN ({BUSY}) OR from_node_id IN ({BUSY}))")
def incident_edges(s: SparkSession, d: str) -> DataFrame:
    g = w.Graph(w.areas(s, d), w.edges(s, d))
    return g.incident(busy_areas(g.edges)).select("id", "edge_type", "to_node_id")


FACTS = "SELECT from_node_id AS id FROM edges WHERE to_s IS NULL AND NOT inferred UNION SELECT to_node_id FROM edges WHERE edge_type = 'PART_OF' AND to_s IS NULL"


def some_ids(e: DataFrame) -> DataFrame:
    now = e.filter("valid_to is null")
    return now.filter("not inferred").select(C("from_node_id").alias("id")).union(now.filter("edge_type = 'PART_OF'").select(C("to_node_id").alias("id"))).distinct()


@query("induced_subgraph", f"WITH {w.EDGES_SQL}, ids AS ({FACTS}) SELECT id, from_node_id, to_node_id, edge_type FROM edges WHERE to_s IS NULL AND from_node_id IN (SELECT id FROM ids) AND to_node_id IN (SELECT id FROM ids)")
def induced_subgraph(s: SparkSession, d: str) -> DataFrame:
    g = w.Graph(w.areas(s, d), w.edges(s, d))
    return g.induced(some_ids(g.edges)).select("id", "from_node_id", "to_node_id", "edge_type")


@query("touching_edges", f"WITH {w.EDGES_SQL}, ids AS ({BUSY}) SELECT id, edge_type FROM edges WHERE to_s IS NULL AND NOT inferred AND (from_node_id IN (SELECT id FROM ids) OR to_node_id IN (SELECT id FROM ids))")
def touching_edges(s: SparkSession, d: str) -> DataFrame:
    g = w.Graph(w.areas(s, d), w.edges(s, d))
    return g.touching(busy_areas(g.edges)).select("id", "edge_type")


ENDS = "ends AS (SELECT id AS edge_id, from_node_id AS node_id, to_node_id AS other_id FROM edges WHERE to_s IS NULL AND NOT inferred UNION SELECT id, to_node_id, from_node_id FROM edges WHERE to_s IS NULL AND NOT inferred)"


@query("neighbours", f"WITH {w.EDGES_SQL}, {ENDS} SELECT DISTINCT node_id, other_id FROM ends WHERE node_id IN ({BUSY})")
def neighbours(s: SparkSession, d: str) -> DataFrame:
    g = w.Graph(w.areas(s, d), w.edges(s, d))
    return g.neighbours(busy_areas(g.edges))


DEGREE = f"{w.OSM}, {w.AREAS}, {w.EDGES_SQL}, {ENDS}, deg AS (SELECT node_id, count(*) AS degree FROM ends WHERE node_id IN (SELECT id FROM osm UNION SELECT id FROM areas) GROUP BY 1)"


def core(s: SparkSession, d: str):
    return w.Graph(w.osm(s, d).unionByName(w.areas(s, d)), w.edges(s, d))


@query("node_degree", f"WITH {DEGREE} SELECT node_id, degree FROM deg")
def node_degree(s: SparkSession, d: str) -> DataFrame:
    return core(s, d).degree()


@query("ego_hubs", f"WITH {DEGREE} SELECT node_id, degree FROM deg WHERE degree >= 3 ORDER BY degree DESC, node_id LIMIT 50")
def ego_hubs(s: SparkSession, d: str) -> DataFrame:
    return core(s, d).hubs()


EGO = f"""{DEGREE}, hubs AS (SELECT node_id FROM deg WHERE degree >= 3 ORDER BY degree DESC, node_id LIMIT 50),
ego AS (SELECT node_id AS anchor_id, other_id, row_number() OVER (PARTITION BY node_id ORDER BY other_id) AS n FROM (SELECT DISTINCT node_id, other_id FROM ends) JOIN hubs USING (node_id) QUALIFY n <= 25)"""


@query("ego_network", f"WITH {EGO} SELECT anchor_id, array_to_string(list_sort(list(other_id)), ',') AS others FROM ego GROUP BY 1")
def ego_network(s: SparkSession, d: str) -> DataFrame:
    m = candidates.ego_network(core(s, d))
    return m.groupBy("anchor_id").agg(F.array_join(F.array_sort(F.collect_list("other_id")), ",").alias("others"))


STREETS = """street AS (SELECT DISTINCT p.to_node_id AS area_id, m.from_node_id AS other_id FROM edges p JOIN edges m ON m.to_node_id = p.to_node_id AND m.edge_type = 'RELATES_TO' AND m.relation = 'mentions_area' AND m.to_s IS NULL WHERE p.edge_type = 'PART_OF' AND p.to_s IS NULL)"""


@query("two_hop_mentions", f"""WITH {w.EDGES_SQL} SELECT DISTINCT p.to_node_id AS area_id, m.to_node_id AS other_id FROM edges p JOIN edges m ON m.from_node_id = p.from_node_id WHERE p.to_s IS NULL AND m.relation = 'mentions_area' AND m.to_s IS NULL""")
def two_hop_mentions(s: SparkSession, d: str) -> DataFrame:
    """The two-hop operator on all edges. The feed mentions no streets, so here every edge makes its element part of an area, and a mention of an area, turned round, mentions the element."""
    e = w.edges(s, d)
    mention = F.get_json_object("properties", "$.relation") == "mentions_area"
    turned = e.filter(mention).withColumns({"from_node_id": C("to_node_id"), "to_node_id": C("from_node_id"), "edge_type": F.lit("RELATES_TO"), "properties": F.to_json(F.struct(F.lit("mentions_street").alias("relation")))})
    return candidates.street_mentions(w.Graph(w.osm(s, d), e.withColumn("edge_type", F.lit("PART_OF")).unionByName(turned)))


@query("pois_in_area", f"WITH {w.OSM}, {w.EDGES_SQL} SELECT o.id, o.label, e.to_node_id AS area_id FROM osm o JOIN edges e ON e.from_node_id = o.id WHERE e.edge_type = 'LOCATED_IN' AND e.to_s IS NULL")
def pois_in_area(s: SparkSession, d: str) -> DataFrame:
    return w.Graph(w.osm(s, d), w.edges(s, d)).located_in().select("id", "label", "area_id")


@query("geojson_features", f"""WITH {w.ODS} SELECT id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ']}},"properties":{{"id":"' || id || '","node_type":"POI","source":"opendata_pois"}}}}' AS feature FROM ods WHERE lon IS NOT NULL AND lat IS NOT NULL""")
def geojson_features(s: SparkSession, d: str) -> DataFrame:
    return w.pois(s, d).filter("lon is not null and lat is not null").select("id", geo.feature(C("lon"), C("lat"), C("rings"), id=C("id"), node_type=C("node_type"), source=C("source")).alias("feature"))


@query("feature_collection", f"""WITH {w.ODS} SELECT 'FeatureCollection' AS type, count(*) AS features, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT id FROM ods WHERE lon IS NOT NULL AND lat IS NOT NULL ORDER BY observed_s DESC, id LIMIT 2000)""")
def feature_collection(s: SparkSession, d: str) -> DataFrame:
    """The map layer of civic places, its features read back from the JSON."""
    g = w.Graph(w.pois(s, d), w.edges(s, d)).feature_collection("POI")
    ids = F.from_json("collection", "type string, features array<struct<properties: struct<id: string>>>")
    return g.select(ids.alias("c")).select("c.type", F.size("c.features").cast("bigint").alias("features"), F.array_join("c.features.properties.id", ",").alias("ids"))


@query("area_features", f"""WITH {w.AREAS} SELECT id, len(rings) AS rings, list_sum(list_transform(rings, lambda r: len(r)))::BIGINT AS points, rings[1][1][1] AS lon FROM areas WHERE rings IS NOT NULL""")
def area_features(s: SparkSession, d: str) -> DataFrame:
    """Areas as polygon features, read back from their JSON."""
    f = geo.feature(C("lon"), C("lat"), C("rings"), id=C("id"))
    x = w.areas(s, d).filter("rings is not null").select("id", F.from_json(f, "geometry struct<type: string, coordinates: array<array<array<double>>>>").alias("f")).filter("f.geometry.type = 'Polygon'")
    rings = C("f.geometry.coordinates")
    return x.select("id", F.size(rings).cast("bigint").alias("rings"), F.aggregate(rings, F.lit(0).cast("long"), lambda n, r: n + F.size(r)).alias("points"), rings[0][0][0].alias("lon"))


@query("topk_neighbours", f"WITH {w.EDGES_SQL} SELECT to_node_id AS area_id, from_node_id AS other_id, confidence FROM edges WHERE to_s IS NULL AND confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY to_node_id ORDER BY confidence DESC, id) <= 3")
def topk_neighbours(s: SparkSession, d: str) -> DataFrame:
    e = w.edges(s, d).filter(valid_at() & C("confidence").isNotNull())
    return top_per(e, ["to_node_id"], [F.desc("confidence"), C("id")], 3).select(C("to_node_id").alias("area_id"), C("from_node_id").alias("other_id"), "confidence")


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Map elements valid now with the area they lie in by their edges, newest first."""
    x = w.Graph(w.osm(s, d), w.edges(s, d)).located_in().select("id", "label", "area_id", "observed_at")
    a = w.areas(s, d).select(C("id").alias("area_id"), C("label").alias("area"))
    return x.join(a, "area_id").orderBy(F.desc("observed_at"), "id").limit(500)
