"""Candidate subgraphs for reasoning, their deduplication, and stored insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import near_join
from tessera.functions.scalars import candidate_key
from tessera.functions.temporal import starts_near, valid_at
from tessera.graph import Graph, top_per

CONFIDENCE_FLOOR = 0.7
GENERATORS = ("spatial_temporal", "area_bridge", "ego_network")
STATUSES = ("new", "confirmed", "dismissed")


def spatial_temporal(graph: Graph, anchor_types: tuple[str, ...] = ("ConstructionSite", "Event"), radius_m: float = 150.0, days: int = 30, anchors: int | None = 50, neighbours: int = 25) -> DataFrame:
    """``anchor_id, other_id, dist_m``: nearest neighbours in space whose start lies near the anchor's time; of all anchors if None is their number."""
    n = graph.nodes.filter(valid_at() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    a = n.filter(F.col("node_type").isin(*anchor_types))
    a = a if anchors is None else a.orderBy(F.desc("observed_at"), "id").limit(anchors)
    a = a.select(F.col("id").alias("anchor_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("valid_from").alias("a_from"), F.col("valid_to").alias("a_to"))
    o = n.select(F.col("id").alias("other_id"), "lat", "lon", F.col("valid_from").alias("o_from"))
    near = near_join(a, o, radius_m, ("a_lat", "a_lon"), ("lat", "lon")).filter("anchor_id <> other_id").filter(starts_near(F.col("o_from"), F.col("a_from"), F.col("a_to"), days))
    return top_per(near, ["anchor_id"], [F.col("dist_m"), F.col("other_id")], neighbours).select("anchor_id", "other_id", "dist_m")


def _mentions(e: DataFrame, relation: str) -> Column:
    return (F.col("edge_type") == "RELATES_TO") & (F.get_json_object("properties", "$.relation") == relation)


def street_mentions(graph: Graph) -> DataFrame:
    """``area_id, other_id``: texts that mention a street which is part of an area (two hops)."""
    e = graph.edges.filter(valid_at())
    p = e.filter("edge_type = 'PART_OF'").select(F.col("to_node_id").alias("area_id"), F.col("from_node_id").alias("street"))
    m = e.filter(_mentions(e, "mentions_street")).select(F.col("to_node_id").alias("street"), F.col("from_node_id").alias("other_id"))
    return p.join(m, "street").select("area_id", "other_id").distinct()


def area_bridge_anchors(graph: Graph, limit: int | None = 50) -> DataFrame:
    """Areas with something in them and a text about them or one of their streets, in the order of ids."""
    e = graph.edges.filter(valid_at())
    physical = e.filter("edge_type = 'LOCATED_IN'").select(F.col("to_node_id").alias("id")).distinct()
    textual = e.filter(_mentions(e, "mentions_area")).select(F.col("to_node_id").alias("id")).union(street_mentions(graph).select(F.col("area_id").alias("id"))).distinct()
    x = graph.nodes.filter(valid_at() & (F.col("node_type") == "GeoArea")).join(physical, "id", "left_semi").join(textual, "id", "left_semi").select("id").distinct()
    return x if limit is None else x.orderBy("id").limit(limit)


def area_bridge(graph: Graph, areas: int = 50, members: int = 40) -> DataFrame:
    """``anchor_id, other_id``: what lies in an area or speaks of it or its streets."""
    e = graph.edges.filter(valid_at())
    direct = e.filter((F.col("edge_type") == "LOCATED_IN") | _mentions(e, "mentions_area")).select(F.col("to_node_id").alias("area_id"), F.col("from_node_id").alias("other_id"))
    a = area_bridge_anchors(graph, areas).select(F.col("id").alias("area_id"))
    every = direct.union(street_mentions(graph)).join(a, "area_id", "left_semi").distinct()
    return top_per(every, ["area_id"], [F.col("other_id")], members).select(F.col("area_id").alias("anchor_id"), "other_id")


def ego_network(graph: Graph, least: int = 3, hubs: int = 50, neighbours: int = 25) -> DataFrame:
    """``anchor_id, other_id``: the busiest nodes and their neighbours over source facts."""
    h = graph.hubs(least, hubs).select(F.col("node_id").alias("id"))
    n = graph.neighbours(h)
    return top_per(n, ["node_id"], [F.col("other_id")], neighbours).select(F.col("node_id").alias("anchor_id"), "other_id")


def collected(members: DataFrame, generator: str) -> DataFrame:
    """``generator, anchor_id, node_ids`` with the anchor first and the members in order."""
    g = members.groupBy("anchor_id").agg(F.array_sort(F.collect_set("other_id")).alias("others"))
    return g.select(F.lit(generator).alias("generator"), "anchor_id", F.concat(F.array("anchor_id"), F.array_remove("others", F.col("anchor_id"))).alias("node_ids"))


def diverse(candidates: DataFrame, nodes: DataFrame, types: int = 2) -> DataFrame:
    """Candidates whose current nodes are of at least ``types`` types, with ``n_types`` and ``n_nodes``."""
    kinds = nodes.filter(valid_at()).select(F.col("id").alias("node_id"), "node_type")
    per = candidates.select("generator", "anchor_id", F.explode("node_ids").alias("node_id")).join(kinds, "node_id").groupBy("generator", "anchor_id")
    return candidates.join(per.agg(F.count_distinct("node_type").alias("n_types"), F.count_distinct("node_id").alias("n_nodes")), ["generator", "anchor_id"]).filter(F.col("n_types") >= types)


def deduplicated(candidates: DataFrame, order: tuple[str, ...] = GENERATORS) -> DataFrame:
    """Of candidates with the same set of nodes the one of the earliest generator (then anchor)."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(g) for g in order]), F.col("generator")), F.lit(99))
    key = F.sha2(F.array_join(F.array_sort(F.array_distinct("node_ids")), "|"), 256)
    x = candidates.groupBy(key.alias("set_key")).agg(F.min(F.struct(rank.alias("rank"), "anchor_id", "generator", "node_ids")).alias("c"))
    return x.select("c.generator", "c.anchor_id", "c.node_ids")


def subgraphs(candidates: DataFrame, graph: Graph, include_inferred: bool = False) -> DataFrame:
    """``generator, anchor_id, nodes, edges`` (arrays of structs) and ``payload`` (JSON) of each candidate."""
    member = candidates.select("generator", "anchor_id", F.explode(F.array_distinct("node_ids")).alias("node_id"))
    n = graph.nodes.filter(valid_at()).select(F.col("id").alias("node_id"), F.struct("id", "node_type", "label", "properties").alias("n"))
    nodes = member.join(n, "node_id").groupBy("generator", "anchor_id").agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    e = graph.edges.filter(valid_at())
    e = e if include_inferred else e.filter(~F.col("inferred"))
    e = e.select("from_node_id", "to_node_id", F.struct("id", "edge_type", "from_node_id", "to_node_id", "properties").alias("e"))
    ends = e.join(member.withColumnRenamed("node_id", "from_node_id"), "from_node_id").join(member.withColumnRenamed("node_id", "to_node_id"), ["generator", "anchor_id", "to_node_id"])
    edges = ends.groupBy("generator", "anchor_id").agg(F.array_sort(F.collect_list("e")).alias("edges"))
    x = nodes.join(edges, ["generator", "anchor_id"], "left").withColumn("edges", F.coalesce("edges", F.slice(F.array(F.lit(None).cast(edges.schema["edges"].dataType.elementType)), 1, 0)))
    return x.withColumn("payload", F.to_json(F.struct("nodes", "edges")))


def new_insights(proposed: DataFrame, stored: DataFrame) -> DataFrame:
    """Insights of at least 0.7, one per key (the surest, then by title), whose key isn't stored."""
    keyed = proposed.filter(F.col("confidence") >= CONFIDENCE_FLOOR).withColumn("candidate_key", candidate_key(F.col("insight_type"), F.col("node_ids")))
    first = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("candidate_key").orderBy(F.desc("confidence"), "title"))).filter("__n = 1").drop("__n")
    return first.join(stored.select("candidate_key"), "candidate_key", "left_anti")


def stored_insights(insights: DataFrame, least: float = 0.0, status: str | None = None, limit: int = 100) -> DataFrame:
    x = insights.filter(F.col("confidence") >= least)
    x = x if status is None else x.filter(F.col("status") == status)
    return x.orderBy(F.desc("confidence"), F.desc("created_at"), "candidate_key").limit(limit)


def set_status(insights: DataFrame, insight_id: str, status: str) -> DataFrame:
    """The insights with one status changed; ValueError for an unknown status, KeyError for an absent insight."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    if not insights.filter(F.col("id") == insight_id).head(1):
        raise KeyError(insight_id)
    return insights.withColumn("status", F.when(F.col("id") == insight_id, status).otherwise(F.col("status")))
