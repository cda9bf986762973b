"""The graph that the queries run on, made from the test tables; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.timestamps import trimmed
from tessera.graph import Graph
from tessera.schema import EDGES, NODES, conform, node_id
from tessera.sources import feeds, places
from tessera.storage import load

C = F.col


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``; combined on the map side, so a hot key is no burden."""
    rest = [c for c in df.columns if c != key]
    return df.filter(C(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[C(f"r.{c}").alias(c) for c in rest])


def osm(spark: SparkSession, d: str) -> DataFrame:
    raw = latest(load(spark, d, "overpass").select("source_id", "type", "id", "lat", "lon", "center", "tags", "fetched_at"), "source_id", "fetched_at")
    return places.overpass(raw, C("fetched_at"))


def pois_all(spark: SparkSession, d: str) -> DataFrame:
    """A node for each row of the portal's places; repeated rows give the same id."""
    return places.ods_pois(load(spark, d, "ods_pois"), F.lit("2025-01-01").cast("timestamp"))


def pois(spark: SparkSession, d: str) -> DataFrame:
    return pois_all(spark, d).dropDuplicates(["id"])


def areas(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "geo_areas")
    # A repeated area may run the other way round: the smallest geometry is the one taken.
    one = raw.groupBy("dataset", "source_id").agg(F.min_by("record", C("record.geografische_polygone.geometry.coordinates")).alias("record"))
    return places.geo_spine(one, F.lit("2025-01-01").cast("timestamp"))


def traffic(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "autobahn").withColumn("identifier", trimmed(C("identifier")))
    return feeds.autobahn(latest(raw, "identifier", "received_at", "delivery_id"), C("received_at"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    raw = load(spark, d, "documents")
    x = raw.select(
        node_id(F.lit("documents"), C("doc_id").cast("string")).alias("id"), "node_type", F.concat_ws(" ", "source", C("doc_id").cast("string")).alias("label"), F.lit("documents").alias("source"), C("doc_id").cast("string").alias("source_id"),
        F.to_json(F.struct(C("text").alias("description"))).alias("properties"), "observed_at", C("published_at").alias("valid_from"), F.lit(False).alias("inferred"),
    )
    return conform(x, NODES)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The latest observation of each edge of ``edge_feed``; its deliveries without source_id each for themselves."""
    raw = load(spark, d, "edge_feed").withColumn("key", F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("source_id", C("delivery_id").cast("string"))))
    x = latest(raw, "key", "observed_at", "delivery_id")
    x = x.withColumns({"id": F.sha2("key", 256), "from_node_id": node_id(F.lit("osm_overpass"), C("from_node_id")), "to_node_id": node_id(F.lit("geo_spine"), C("to_node_id")), "valid_from": F.coalesce("valid_from", "observed_at")})
    return conform(x, EDGES)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return osm(spark, d).unionByName(pois(spark, d)).unionByName(areas(spark, d)).unionByName(traffic(spark, d)).unionByName(texts(spark, d))


def graph(spark: SparkSession, d: str) -> Graph:
    return Graph(nodes(spark, d), edges(spark, d))


# The same tables as common table expressions. Times are seconds since 1970.
S = lambda c: f"(epoch_us({c}) // 1000000)"
OSM = f"""osm AS (
  SELECT sha256('osm_overpass|' || source_id) AS id, 'POI' AS node_type, 'osm_overpass' AS source, source_id,
         substr(coalesce(nullif(any_value(tags['name']), ''), nullif(any_value(tags['brand']), ''), nullif(any_value(tags['operator']), ''), 'OSM ' || replace(source_id, '/', ' ')), 1, 200) AS label,
         any_value(tags['shop']) AS shop, any_value(tags['amenity']) AS amenity, max({S('fetched_at')}) AS observed_s, NULL::BIGINT AS from_s,
         max(CASE WHEN type = 'way' THEN center.lat ELSE lat END) AS lat, max(CASE WHEN type = 'way' THEN center.lon ELSE lon END) AS lon
  FROM overpass WHERE source_id IS NOT NULL GROUP BY source_id)"""
ODS = """ods AS (
  SELECT sha256('opendata_pois|' || sid) AS id, 'POI' AS node_type, 'opendata_pois' AS source, sid AS source_id, label, lat, lon, statbezibe, 1735689600::BIGINT AS observed_s, NULL::BIGINT AS from_s
  FROM (SELECT DISTINCT substr(sha256(coalesce(_dataset, '') || '|' || name || '|' || coalesce(geo_point_2d.lon::VARCHAR, 'None') || '|' || coalesce(geo_point_2d.lat::VARCHAR, 'None')), 1, 20) AS sid,
               substr(name, 1, 200) AS label, geo_point_2d.lat AS lat, geo_point_2d.lon AS lon, statbezibe
        FROM (SELECT *, coalesce(nullif(objektname, ''), 'Unbenannt') AS name FROM ods_pois)))"""
AREAS = """areas AS (
  SELECT sha256('geo_spine|' || sid) AS id, 'GeoArea' AS node_type, 'geo_spine' AS source, sid AS source_id, label, area_type, parent, rings, 1735689600::BIGINT AS observed_s, NULL::BIGINT AS from_s
  FROM (SELECT dataset, source_id, CASE WHEN dataset = 'stadtbezirke' THEN 'stadtbezirk' ELSE 'statistischer_bezirk' END AS area_type,
          coalesce(CASE WHEN dataset = 'stadtbezirke' THEN any_value(record.stadtbezirk_nr) ELSE any_value(record.statistischer_bezirk_nr) END, '') AS sid,
          coalesce(CASE WHEN dataset = 'stadtbezirke' THEN any_value(record.stadtbezirk_bezeichnung) ELSE any_value(record.statistischer_bezirk) END, 'Unknown') AS label,
          CASE WHEN dataset <> 'stadtbezirke' THEN any_value(record.stadtbezirk_nr) END AS parent, min(record.geografische_polygone.geometry.coordinates) AS rings
        FROM geo_areas GROUP BY dataset, source_id))"""
TRAFFIC = f"""traffic AS (
  SELECT sha256('autobahn|' || identifier) AS id, CASE WHEN r._kind = 'roadwork' THEN 'ConstructionSite' ELSE 'Event' END AS node_type, 'autobahn' AS source, identifier AS source_id,
         substr(coalesce(nullif(array_to_string(r.title, ' '), ''), r._road || ' ' || r._kind), 1, 200) AS label, {S('r.received_at')} AS observed_s, r._lat AS lat, r._lon AS lon, r._kind AS kind, r.startTimestamp AS start
  FROM (SELECT identifier, arg_max(a, (received_at, delivery_id)) AS r
        FROM (SELECT regexp_replace(identifier, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS identifier, received_at, delivery_id, {{'_kind': _kind, 'title': title, '_road': _road, 'received_at': received_at, '_lat': _lat, '_lon': _lon, 'startTimestamp': startTimestamp}} AS a FROM autobahn WHERE identifier IS NOT NULL)
        GROUP BY identifier))"""
TEXTS = f"""texts AS (
  SELECT sha256('documents|' || doc_id) AS id, node_type, 'documents' AS source, doc_id::VARCHAR AS source_id, source || ' ' || doc_id AS label, text, {S('observed_at')} AS observed_s, {S('published_at')} AS from_s FROM documents)"""
EDGES_SQL = f"""edges AS (
  SELECT sha256(key) AS id, r.edge_type AS edge_type, sha256('osm_overpass|' || r.from_node_id) AS from_node_id, sha256('geo_spine|' || r.to_node_id) AS to_node_id, r.properties AS properties, r.source AS source, r.source_id AS source_id,
         json_extract_string(r.properties, '$.relation') AS relation, {S('r.observed_at')} AS observed_s, {S('coalesce(r.valid_from, r.observed_at)')} AS from_s, {S('r.valid_to')} AS to_s, r.inferred AS inferred, r.confidence AS confidence
  FROM (SELECT key, arg_max(e, (e.observed_at, e.delivery_id)) AS r FROM (SELECT coalesce(source, '') || '|' || coalesce(source_id, delivery_id::VARCHAR) AS key, edge_feed AS e FROM edge_feed) GROUP BY key))"""
NODES_SQL = """nodes AS (
  SELECT id, node_type, label, source, source_id, observed_s, from_s FROM osm UNION ALL SELECT id, node_type, label, source, source_id, observed_s, from_s FROM ods UNION ALL
  SELECT id, node_type, label, source, source_id, observed_s, from_s FROM areas UNION ALL SELECT id, node_type, label, source, source_id, observed_s, try_cast(NULL AS BIGINT) FROM traffic UNION ALL
  SELECT id, node_type, label, source, source_id, observed_s, from_s FROM texts)"""
ALL_NODES = f"{OSM}, {ODS}, {AREAS}, {TRAFFIC}, {TEXTS}, {NODES_SQL}"
HAVERSINE = "2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


def metres(a: str, b: str, lat: str = "lat", lon: str = "lon") -> str:
    """SQL of the distance between two aliases."""
    return HAVERSINE.format(lat1=f"{a}.{lat}", lon1=f"{a}.{lon}", lat2=f"{b}.{lat}", lon2=f"{b}.{lon}")
