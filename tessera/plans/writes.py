"""Queries on writes: upserts, idempotence, runs and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.temporal import valid_at
from tessera.operators import linking, runs, upsert
from tessera.plans import world as w
from tessera.plans.reads import secs
from tessera.schema import EDGES, NODES, conform
from tessera.sources import registry

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


def _stations(s: SparkSession, d: str, cond: str) -> DataFrame:
    """A node for each weather station with the condition first or last reported."""
    b = w.load(s, d, "brightsky").select(C("_source.dwd_station_id").alias("source_id"), C("_source.station_name").alias("label"), "condition", C("received_at").alias("observed_at"), "obs_id")
    pick = F.min_by if cond == "first" else F.max_by
    x = b.filter("source_id is not null").groupBy("source_id").agg(pick(F.struct("label", "condition", "observed_at"), F.struct("observed_at", "obs_id")).alias("r")).select("source_id", "r.*")
    x = x.select(F.sha2(F.concat(F.lit("dwd|"), "source_id"), 256).alias("id"), F.lit("WeatherObservation").alias("node_type"), "label", F.to_json(F.struct("condition")).alias("properties"), F.lit("dwd").alias("source"), "source_id", "observed_at", F.lit(False).alias("inferred"))
    return conform(x, NODES)


STATIONS = """
b AS (SELECT _source.dwd_station_id AS sid, {'l': _source.station_name, 'c': condition} AS v, (received_at, obs_id) AS k FROM brightsky WHERE _source.dwd_station_id IS NOT NULL),
fl AS (SELECT sid, arg_min(v, k) AS f, arg_max(v, k) AS l FROM b GROUP BY sid)"""


@query("content_hash_diff", f"WITH {STATIONS} SELECT sid AS source_id, (f IS DISTINCT FROM l) AS changed FROM fl")
def content_hash_diff(s: SparkSession, d: str) -> DataFrame:
    h = lambda x: x.select("source_id", upsert.content_hash(C("label"), C("properties")).alias("h"))
    a, b = h(_stations(s, d, "first")), h(_stations(s, d, "last")).withColumnRenamed("h", "h2")
    return a.join(b, "source_id").select("source_id", (C("h") != C("h2")).alias("changed"))


@query("scd2_upsert", f"""WITH {STATIONS}
SELECT sid AS source_id, 'touched' AS change, true AS is_open FROM fl WHERE f IS NOT DISTINCT FROM l
UNION ALL SELECT sid, 'closed', false FROM fl WHERE f IS DISTINCT FROM l UNION ALL SELECT sid, 'inserted', true FROM fl WHERE f IS DISTINCT FROM l""")
def scd2_upsert(s: SparkSession, d: str) -> DataFrame:
    out = upsert.upsert_nodes(_stations(s, d, "first"), _stations(s, d, "last"), now())
    return out.select("source_id", "change", C("valid_to").isNull().alias("is_open"))


@query("edge_dedup", f"""WITH {w.EDGES_SQL}, base AS (SELECT * FROM edges WHERE source_id IS NOT NULL AND observed_s < 1719792000), late AS (SELECT DISTINCT source, source_id FROM edges WHERE source_id IS NOT NULL AND observed_s >= 1704067200)
SELECT source, source_id, CASE WHEN (source, source_id) IN (SELECT (source, source_id) FROM late) AND to_s IS NULL THEN 'touched' ELSE 'untouched' END AS change FROM base
UNION ALL SELECT source, source_id, 'inserted' FROM late WHERE (source, source_id) NOT IN (SELECT (source, source_id) FROM base WHERE to_s IS NULL)""")
def edge_dedup(s: SparkSession, d: str) -> DataFrame:
    e = w.edges(s, d).filter("source_id is not null and source is not null")
    base, late = e.filter(F.unix_seconds("observed_at") < 1719792000), e.filter(F.unix_seconds("observed_at") >= 1704067200)
    return upsert.upsert_edges(conform(base, EDGES), conform(late, EDGES), now()).select("source", "source_id", "change")


@query("missing_edges", f"""WITH {w.EDGES_SQL}, p AS (SELECT DISTINCT from_node_id, to_node_id FROM edges)
SELECT from_node_id, to_node_id FROM p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.from_node_id = p.from_node_id AND e.to_node_id = p.to_node_id AND e.edge_type = 'LOCATED_IN' AND e.to_s IS NULL)""")
def missing_edges(s: SparkSession, d: str) -> DataFrame:
    e = w.edges(s, d)
    return linking.missing(e.select("from_node_id", "to_node_id").distinct(), e, "LOCATED_IN")


@query("single_open_version", f"WITH {w.EDGES_SQL} SELECT source, source_id, count(*) AS open FROM edges WHERE to_s IS NULL AND source_id <> '' GROUP BY ALL HAVING count(*) > 1")
def single_open_version(s: SparkSession, d: str) -> DataFrame:
    return upsert.more_than_one_open(w.edges(s, d))


@query("unseen_items", f"WITH {w.TRAFFIC}, seen AS (SELECT DISTINCT regexp_replace(identifier, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS i FROM autobahn WHERE received_at < TIMESTAMPTZ '2024-07-01 00:00:00+00' AND identifier IS NOT NULL) SELECT source_id, label FROM traffic WHERE source_id NOT IN (SELECT i FROM seen)")
def unseen_items(s: SparkSession, d: str) -> DataFrame:
    seen = w.load(s, d, "autobahn").filter(C("received_at") < F.lit("2024-07-01T00:00:00Z").cast("timestamp")).select(w.trimmed(C("identifier")).alias("source_id")).filter("source_id is not null")
    return upsert.unseen(w.traffic(s, d), seen, "source_id").select("source_id", "label")


def _runs(s: SparkSession, d: str) -> DataFrame:
    """A run log made of the deliveries' batches: one run of a feed per batch."""
    parts = []
    for name in ("autobahn", "edge_feed"):
        g = w.load(s, d, name).groupBy("batch_id").agg(F.min("received_at").alias("started_at"), F.max("received_at").alias("finished_at"), F.count(F.lit(1)).cast("int").alias("nodes_written"))
        parts.append(g.select(F.lit(name).alias("connector"), "started_at", "finished_at", F.when(C("batch_id") % 5 == 0, "error").otherwise("ok").alias("status"), "nodes_written", C("batch_id").cast("string").alias("checkpoint")))
    return parts[0].unionByName(parts[1])


RUNS = """runs AS (
  SELECT 'autobahn' AS connector, batch_id, min(received_at) AS st, max(received_at) AS fi, count(*)::INT AS nodes_written FROM autobahn GROUP BY batch_id UNION ALL
  SELECT 'edge_feed', batch_id, min(received_at), max(received_at), count(*)::INT FROM edge_feed GROUP BY batch_id),
last_run AS (SELECT *, CASE WHEN batch_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status FROM runs QUALIFY row_number() OVER (PARTITION BY connector ORDER BY st DESC, fi DESC) = 1)"""


@query("latest_run", f"WITH {RUNS} SELECT connector, epoch_us(st) // 1000000 AS started_s, status, nodes_written FROM last_run")
def latest_run(s: SparkSession, d: str) -> DataFrame:
    r = _runs(s, d).select("connector", "started_at", "finished_at", "status", "nodes_written", "checkpoint")
    return runs.latest_run(r).select("connector", secs("started_at").alias("started_s"), "status", "nodes_written")


@query("latest_checkpoint", f"WITH {RUNS} SELECT connector, arg_max(batch_id::VARCHAR, (fi, batch_id::VARCHAR)) AS checkpoint FROM runs WHERE batch_id % 5 <> 0 GROUP BY 1")
def latest_checkpoint(s: SparkSession, d: str) -> DataFrame:
    return runs.latest_checkpoint(_runs(s, d))


@query("source_status", f"""WITH {RUNS}, cat(name, shape, enabled) AS (VALUES {", ".join(f"('{n}', '{sh}', {str(e).lower()})" for n, sh, _, _, e in registry.SOURCES)})
SELECT name, shape, enabled, status, epoch_us(st) // 1000000 AS started_s FROM cat LEFT JOIN last_run ON name = connector""")
def source_status(s: SparkSession, d: str) -> DataFrame:
    x = runs.source_status(registry.catalogue(s), _runs(s, d))
    return x.select("name", "shape", "enabled", "status", secs("started_at").alias("started_s"))


@query("source_catalog", f"SELECT * FROM (VALUES {', '.join(f'''('{n}', '{sh}', '{c}', {str(e).lower()})''' for n, sh, c, _, e in registry.SOURCES)}) t(name, shape, cadence_cron, enabled)")
def source_catalog(s: SparkSession, d: str) -> DataFrame:
    return registry.catalogue(s).drop("description")


@query("hourly_rollup", """SELECT _source.dwd_station_id AS station, epoch_us(date_trunc('hour', received_at)) // 1000000 AS hour_s, count(*) AS n, round(avg(temperature), 4) AS temperature, round(avg(wind_speed), 4) AS wind_speed
FROM brightsky GROUP BY ALL""")
def hourly_rollup(s: SparkSession, d: str) -> DataFrame:
    b = w.load(s, d, "brightsky").withColumn("station", C("_source.dwd_station_id"))
    x = runs.hourly(b, "received_at", ["station"], ["temperature", "wind_speed"])
    return x.select("station", secs("hour").alias("hour_s"), "n", F.round("temperature", 4).alias("temperature"), F.round("wind_speed", 4).alias("wind_speed"))


@query("current_edges", f"WITH {w.EDGES_SQL} SELECT edge_type, inferred, count(*) AS n FROM edges WHERE to_s IS NULL GROUP BY ALL")
def current_edges(s: SparkSession, d: str) -> DataFrame:
    return w.edges(s, d).filter(valid_at()).groupBy("edge_type", "inferred").agg(F.count(F.lit(1)).alias("n"))
