"""Queries on what changes stored tables: decisions, run logs and tables themselves; and on reads by text or id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions.scalars import epoch_time
from tessera.functions.temporal import parse_as_of, valid_at
from tessera.operators import candidates, resolution, runs
from tessera.plans import world as w
from tessera.storage import scratch

QUERIES: dict = {}
SQL: dict = {}
C = F.col


def now() -> Column:
    return F.lit("2026-01-01T00:00:00Z").cast("timestamp")


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def _insights(s: SparkSession, d: str) -> DataFrame:
    """Edges that a model inferred, as stored insights."""
    x = w.load(s, d, "edge_feed").filter("inferred")
    return schema.conform(x.select(C("delivery_id").cast("string").alias("id"), C("edge_type").alias("insight_type"), "confidence", F.when(C("delivery_id") % 3 == 0, "dismissed").otherwise("new").alias("status")), schema.INSIGHTS)


@query("insight_status", """SELECT delivery_id::VARCHAR AS id, CASE WHEN delivery_id = (SELECT min(delivery_id) FROM edge_feed WHERE inferred) THEN 'confirmed' WHEN delivery_id % 3 = 0 THEN 'dismissed' ELSE 'new' END AS status FROM edge_feed WHERE inferred""")
def insight_status(s: SparkSession, d: str) -> DataFrame:
    """All insights after one has been confirmed."""
    first = w.load(s, d, "edge_feed").filter("inferred").agg(F.min("delivery_id")).first()[0]
    i = _insights(s, d)
    return (i if first is None else candidates.set_status(i, str(first), "confirmed")).select("id", "status")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Edges with a confidence as candidate pairs; every seventh is rejected already."""
    x = w.load(s, d, "edge_feed").filter("confidence is not null")
    return schema.conform(x.select(C("delivery_id").cast("string").alias("id"), C("from_node_id").alias("node_a_id"), C("to_node_id").alias("node_b_id"), C("edge_type").alias("method"), "confidence", F.when(C("delivery_id") % 7 == 0, False).alias("resolved")), schema.CANDIDATES)


_OPEN = "SELECT min(delivery_id) FROM edge_feed WHERE confidence IS NOT NULL AND delivery_id % 7 <> 0"


@query("resolve_candidate", f"""WITH p AS (SELECT *, delivery_id = ({_OPEN}) AS hit FROM edge_feed WHERE confidence IS NOT NULL)
SELECT 'candidate' AS kind, delivery_id::VARCHAR AS id, CASE WHEN hit THEN true WHEN delivery_id % 7 = 0 THEN false END AS resolved, CASE WHEN hit THEN 'tester' END AS resolved_by, CASE WHEN hit THEN 1767225600 END AS at_s FROM p
UNION ALL SELECT 'edge', sha256('SAME_AS:' || from_node_id || ':' || to_node_id), NULL, 'resolution', 1767225600 FROM p WHERE hit""")
def resolve_candidate(s: SparkSession, d: str) -> DataFrame:
    """All candidates after the first open one has been merged, and the edge that makes."""
    p = _pairs(s, d)
    first = p.filter("resolved is null").agg(F.min(C("id").cast("long"))).first()[0]
    done, edge = resolution.resolve(p, str(first), True, "tester", now()) if first is not None else (p, resolution.same_as(p.limit(0), now()))
    x = done.select(F.lit("candidate").alias("kind"), "id", "resolved", "resolved_by", F.unix_seconds("resolved_at").alias("at_s"))
    return x.unionByName(edge.select(F.lit("edge").alias("kind"), "id", F.lit(None).cast("boolean").alias("resolved"), C("source").alias("resolved_by"), F.unix_seconds("observed_at").alias("at_s")))


@query("new_candidates", """WITH p AS (SELECT from_node_id AS a, to_node_id AS b, max((confidence, edge_type)) AS c FROM edge_feed WHERE confidence IS NOT NULL GROUP BY ALL)
SELECT a AS node_a_id, b AS node_b_id, c[1] AS confidence, c[2] AS method FROM (SELECT a, b, c FROM p) WHERE (a, b) NOT IN (SELECT (from_node_id, to_node_id) FROM edge_feed WHERE delivery_id % 7 = 0 AND confidence IS NOT NULL)""")
def new_candidates(s: SparkSession, d: str) -> DataFrame:
    """Pairs, each by its surest method, that aren't among those rejected."""
    p = _pairs(s, d)
    return resolution.new_candidates(p.select("node_a_id", "node_b_id", "confidence", "method"), p.filter("resolved = false")).select("node_a_id", "node_b_id", "confidence", "method")


@query("review_states", """WITH p AS (SELECT delivery_id, from_node_id AS a, to_node_id AS b, confidence, CASE WHEN delivery_id % 7 = 0 THEN 'rejected' ELSE 'pending' END AS state FROM edge_feed WHERE confidence IS NOT NULL),
t AS (SELECT state, delivery_id FROM p QUALIFY row_number() OVER (PARTITION BY state ORDER BY confidence DESC, a, b, delivery_id::VARCHAR) <= 50), e AS (SELECT 'all' AS state, delivery_id FROM p QUALIFY row_number() OVER (ORDER BY confidence DESC, a, b, delivery_id::VARCHAR) <= 50)
SELECT state, delivery_id::VARCHAR AS id FROM t UNION ALL SELECT state, delivery_id::VARCHAR FROM e""")
def review_states(s: SparkSession, d: str) -> DataFrame:
    """The first fifty of the review queue in each of its states; the merged one is empty."""
    p = _pairs(s, d)
    n = p.select(C("node_a_id").alias("id")).union(p.select("node_b_id")).distinct().select("id", F.lit("l").alias("label"), F.lit("s").alias("source"), F.lit(None).cast("timestamp").alias("valid_to"))
    q = lambda state: resolution.review_queue(p, n, state, 50).select(F.lit(state).alias("state"), "id")
    return q("pending").unionByName(q("rejected")).unionByName(q("merged")).unionByName(q("all"))


@query("run_log", """SELECT n_name AS connector, CASE WHEN n_name = 'GERMANY' THEN 'ok' ELSE 'running' END AS status, CASE WHEN n_name = 'GERMANY' THEN 7 END AS nodes_written, CASE WHEN n_name = 'GERMANY' THEN '{"page": 2}' END AS checkpoint, CASE WHEN n_name = 'GERMANY' THEN 1767225600 END AS finished_s FROM nation
UNION ALL SELECT 'council', 'running', NULL, NULL, NULL""")
def run_log(s: SparkSession, d: str) -> DataFrame:
    """Runs of 25 connectors of which one ends, and one that starts then."""
    began = F.lit("2025-12-31T00:00:00Z").cast("timestamp")
    r = schema.conform(w.load(s, d, "nation").select(C("n_name").alias("connector"), began.alias("started_at"), F.lit("running").alias("status")), schema.RUNS)
    r = runs.started(runs.finished(r, "GERMANY", began, now(), "ok", 7, 0, '{"page": 2}'), "council", now())
    return r.select("connector", "status", "nodes_written", "checkpoint", F.unix_seconds("finished_at").alias("finished_s"))


@query("migrate_verify", "SELECT * FROM (VALUES ('edges', true), ('ingestion_runs', true), ('insights', false), ('nodes', true), ('resolution_candidates', true)) t(name, there)")
def migrate_verify(s: SparkSession, d: str) -> DataFrame:
    """Which tables a fresh folder has once they are made, after one has lost a column."""
    path = scratch(s, "tables")
    schema.create_tables(s, path)
    s.createDataFrame([], "id string").write.mode("overwrite").parquet(f"{path}/insights")
    missing = schema.missing_tables(s, path)
    return s.createDataFrame([(n, n not in missing) for n in sorted(schema.TABLES)], "name string, there boolean")


@query("as_of_text", f"WITH {w.EDGES_SQL} SELECT t AS as_of, count(*) AS n FROM edges, (VALUES ('2024-06-01', 1717200000), ('2024-06-01T12:00:00+02:00', 1717236000)) v(t, day_s) WHERE (from_s IS NULL OR from_s <= day_s) AND (to_s IS NULL OR to_s > day_s) GROUP BY 1 UNION ALL SELECT 'now', count(*) FROM edges WHERE to_s IS NULL")
def as_of_text(s: SparkSession, d: str) -> DataFrame:
    """Edges valid at times written without zone, with an offset, and not at all."""
    e = w.edges(s, d)
    n = lambda text: e.filter(valid_at(parse_as_of(text))).agg(F.count(F.lit(1)).alias("n")).select(F.lit(text or "now").alias("as_of"), "n")
    return n("2024-06-01").unionByName(n("2024-06-01T12:00:00+02:00")).unionByName(n(""))


@query("point_lookup", f"WITH {w.OSM} SELECT id, label FROM osm WHERE source_id = (SELECT min(source_id) FROM overpass)")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    key = w.load(s, d, "overpass").agg(F.min("source_id")).first()[0]
    ident = s.range(1).select(schema.node_id(F.lit("osm_overpass"), F.lit(key))).first()[0]
    return w.Graph(w.osm(s, d), w.edges(s, d)).node(ident).select("id", "label")


@query("epoch_times", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch_us(ts) // 1000000 END AS at_s FROM events")
def epoch_times(s: SparkSession, d: str) -> DataFrame:
    """Epoch seconds of which 0 is unknown."""
    e = w.load(s, d, "events")
    return e.select("event_id", F.unix_seconds(epoch_time(F.when(C("event_id") % 5 == 0, 0).otherwise(F.unix_seconds(C("ts").cast("timestamp"))))).alias("at_s"))


@query("size_gate", f"WITH {w.EDGES_SQL}, c AS (SELECT to_node_id AS anchor_id, count(DISTINCT from_node_id) AS n FROM edges WHERE to_s IS NULL AND from_node_id IN (SELECT sha256('osm_overpass|' || source_id) FROM overpass) GROUP BY 1) SELECT anchor_id, n AS n_nodes FROM c WHERE n >= 2")
def size_gate(s: SparkSession, d: str) -> DataFrame:
    """Candidates of an area and what is tied to it, kept if two current nodes or more are in it."""
    e = w.edges(s, d).filter(valid_at())
    c = e.groupBy(C("to_node_id").alias("anchor_id")).agg(F.collect_set("from_node_id").alias("node_ids")).withColumn("generator", F.lit("area_bridge"))
    return candidates.diverse(c, w.osm(s, d), 1).filter("n_nodes >= 2").select("anchor_id", "n_nodes")
