"""Runs of sources and derived steps over stored tables, with a run log and isolated failures."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.graph import Graph
from tessera.operators import candidates, linking, resolution, runs, upsert
from tessera.schema import CANDIDATES, EDGES, INSIGHTS, TABLES, conform
from tessera.streaming.ingest import current_table

logger = logging.getLogger(__name__)


class Tables:
    """The graph's tables below a folder. A write makes a new version beside the one it was read from; readers take the newest complete one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        df = current_table(self.spark, f"{self.path}/{name}")
        return self.spark.createDataFrame([], TABLES[name]) if df is None else df

    def write(self, name: str, df: DataFrame) -> None:
        from tessera.storage import filesystem

        fs, p = filesystem(self.spark, f"{self.path}/{name}")
        there = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("version=")] if fs.exists(p) else []
        conform(df, TABLES[name]).write.parquet(f"{self.path}/{name}/version={max(there, default=0) + 1}")

    def graph(self) -> Graph:
        return Graph(self.read("nodes"), self.read("edges"))


def store(tables: Tables, nodes: DataFrame | None, edges: DataFrame | None, now: datetime) -> tuple[int, int]:
    """Upserts a batch; returns how many node versions and edges were inserted."""
    written = []
    for name, batch, put in (("nodes", nodes, upsert.upsert_nodes), ("edges", edges, upsert.upsert_edges)):
        n = 0
        if batch is not None:
            old = tables.read(name).count()
            out = put(tables.read(name), conform(batch, TABLES[name]), F.lit(now))
            tables.write(name, out)
            n = tables.read(name).count() - old
        written.append(n)
    return written[0], written[1]


def run(tables: Tables, connector: str, step: Callable[[Tables], tuple[DataFrame | None, DataFrame | None]], now: datetime, checkpoint: str | None = None) -> bool:
    """One run of a source or derived step, logged as ok or error; an error doesn't leave here."""
    begun = F.lit(now)
    tables.write("ingestion_runs", runs.started(tables.read("ingestion_runs"), connector, begun))
    try:
        n, e = store(tables, *step(tables), now)
        done = {"status": "ok", "nodes": n, "edges": e, "checkpoint": checkpoint}
    except Exception as error:  # noqa: BLE001
        logger.exception("%s failed", connector)
        done = {"status": "error", "error": str(error)[:500]}
    tables.write("ingestion_runs", runs.finished(tables.read("ingestion_runs"), connector, begun, begun, **done))
    return done["status"] == "ok"


def full_load(tables: Tables, steps: list[tuple[str, Callable]], now: datetime) -> dict[str, bool]:
    """All steps in their order; one that fails doesn't stop the others."""
    return {name: run(tables, name, step, now) for name, step in steps}


def locate(node_type: str, source: str | None = None) -> Callable:
    """Step: LOCATED_IN edges for nodes of a type."""

    def step(t: Tables):
        g = t.graph()
        pairs = linking.located_in(g.nodes, g.nodes.filter("node_type = 'GeoArea'"), g.edges, node_type, source)
        return None, conform(linking.as_edges(pairs, "LOCATED_IN", "spatial_join", F.lit(None).cast("timestamp")), EDGES)

    return step


def link_texts(node_types: tuple[str, ...], limit: int | None = 5000) -> Callable:
    """Step: inferred RELATES_TO edges from the newest text nodes, or all if there is no limit, to the areas and streets they name."""

    def step(t: Tables):
        g = t.graph()
        texts = g.nodes.filter(F.col("node_type").isin(*node_types) & F.col("valid_to").isNull())
        texts = texts if limit is None else texts.orderBy(F.desc("observed_at"), "id").limit(limit)
        found = linking.text_links(texts, g.nodes.filter("node_type = 'GeoArea'"), g.nodes.filter("node_type = 'Road' and rings is null"))
        sid = F.concat_ws(":", "relation", "from_node_id", "to_node_id")
        e = found.select("from_node_id", "to_node_id", F.lit("RELATES_TO").alias("edge_type"), F.lit("text_linker").alias("source"), sid.alias("source_id"), F.sha2(sid, 256).alias("id"), F.to_json(F.struct("relation", "term")).alias("properties"), F.lit(True).alias("inferred"), "confidence")
        return None, conform(e, EDGES)

    return step


def resolve_entities(tables: Tables, now: datetime, node_type: str = "POI") -> None:
    """Pairs by place and by name: sure ones become SAME_AS edges, the next ones candidates for review."""
    nodes = tables.read("nodes")
    near = resolution.geo_candidates(nodes).select("node_a_id", "node_b_id", "confidence", F.lit("geo").alias("method"))
    labels = resolution.similar_labels(nodes, node_type)
    n = nodes.filter((F.col("node_type") == node_type) & F.col("valid_to").isNull())
    a, b = (n.select(F.col("id").alias(f"{k}_id"), F.col("source").alias(f"source_{k}"), F.col("label").alias(f"label_{k}")) for k in "ab")
    named = labels.join(a, ["source_a", "label_a"]).join(b, ["source_b", "label_b"]).select(F.least("a_id", "b_id").alias("node_a_id"), F.greatest("a_id", "b_id").alias("node_b_id"), F.round("similarity", 3).alias("confidence"), F.lit("name").alias("method"))
    there = tables.read("resolution_candidates")
    new = resolution.new_candidates(near.unionByName(named), there).withColumn("decision", resolution.triage(F.col("confidence")))
    merged = new.filter("decision = 'merge'")
    store(tables, None, conform(resolution.same_as(merged, F.lit(now)), EDGES), now)
    kept = new.filter("decision <> 'drop'").withColumns({"id": F.sha2(F.concat_ws("|", "node_a_id", "node_b_id"), 256), "resolved": F.when(F.col("decision") == "merge", F.lit(True)), "resolved_at": F.when(F.col("decision") == "merge", F.lit(now)), "resolved_by": F.when(F.col("decision") == "merge", F.lit("auto"))})
    tables.write("resolution_candidates", there.unionByName(conform(kept, CANDIDATES)))


def scan(tables: Tables, answer: Callable[[DataFrame], DataFrame], now: datetime, kinds: tuple[str, ...] = ("inefficiency", "pattern")) -> int:
    """Candidates of all generators, once per node set, answered for each kind; new insights of 0.7 or more are stored.

    ``answer`` adds ``raw``, the model's text, to ``generator, anchor_id, node_ids, payload, insight_type``.
    """
    from tessera.functions.scalars import candidate_key
    from tessera.functions.text import derive_title, parse_insights

    g = tables.graph()
    members = {"spatial_temporal": candidates.spatial_temporal(g), "area_bridge": candidates.area_bridge(g), "ego_network": candidates.ego_network(g)}
    every = None
    for name, m in members.items():
        c = candidates.collected(m, name)
        every = c if every is None else every.unionByName(c)
    kept = candidates.deduplicated(candidates.diverse(every, g.nodes, 1).filter("n_nodes >= 2").select("generator", "anchor_id", "node_ids"))
    asked = candidates.subgraphs(kept, g).select("generator", "anchor_id", "payload").join(kept, ["generator", "anchor_id"]).withColumn("insight_type", F.explode(F.array(*[F.lit(k) for k in kinds])))
    i = answer(asked).select("insight_type", "node_ids", F.explode(parse_insights(F.col("raw"))).alias("i"))
    get = lambda k: F.get_json_object("i", f"$.{k}")
    proposed = i.select("insight_type", "node_ids", derive_title(get("title"), get("description")).alias("title"), get("description").alias("description"), get("confidence").try_cast("double").alias("confidence"))
    there = tables.read("insights")
    new = candidates.new_insights(proposed, there).withColumns({"id": candidate_key(F.col("insight_type"), F.col("node_ids")), "evidence_node_ids": F.col("node_ids"), "status": F.lit("new"), "created_at": F.lit(now)})
    tables.write("insights", there.unionByName(conform(new, INSIGHTS)))
    return tables.read("insights").count() - there.count()
