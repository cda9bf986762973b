"""Edges between nodes that share a place, a name or a key, and places named in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.temporal import valid_at
from tessera.functions.text import gazetteer, mentions, node_text
from tessera.operators.spatial_join import spatial_pairs

AREA_ALONE, AREA_AMONG, STREET, FLOOR = 0.85, 0.7, 0.9, 0.6


def missing(pairs: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    """Pairs ``from_node_id, to_node_id`` without a current edge of the type."""
    there = edges.filter(valid_at() & (F.col("edge_type") == edge_type)).select("from_node_id", "to_node_id")
    return pairs.join(there, ["from_node_id", "to_node_id"], "left_anti")


def as_edges(pairs: DataFrame, edge_type: str, source: str, now: Column) -> DataFrame:
    """Edge rows with a source_id made of type and ends, so that they are found again."""
    sid = F.concat_ws(":", F.lit(edge_type), "from_node_id", "to_node_id")
    return pairs.withColumns({"edge_type": F.lit(edge_type), "source": F.lit(source), "source_id": sid, "id": F.sha2(F.concat_ws("|", F.lit(source), sid), 256), "observed_at": now, "inferred": F.lit(False), "properties": F.lit("{}")})


def located_in(nodes: DataFrame, areas: DataFrame, edges: DataFrame, node_type: str, source: str | None = None) -> DataFrame:
    """``from_node_id, to_node_id``: current nodes of a type inside current areas, not linked so far.

    Nodes without position and areas without rings take no part. The join is the quadtree's, so neither side is broadcast.
    """
    n = nodes.filter(valid_at() & (F.col("node_type") == node_type) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    n = n if source is None else n.filter(F.col("source") == source)
    a = areas.filter(valid_at() & F.col("rings").isNotNull())
    inside = spatial_pairs(n.select("lat", "lon").distinct(), a.select(F.col("id").alias("area"), "rings"), 0.0).filter("kind = 'inside'")
    pairs = n.select(F.col("id").alias("from_node_id"), "lat", "lon").join(inside.select(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"), F.col("area").alias("to_node_id")), ["lat", "lon"])
    return missing(pairs.select("from_node_id", "to_node_id").distinct(), edges, "LOCATED_IN")


def part_of_by_name(children: DataFrame, areas: DataFrame, edges: DataFrame, name: Column) -> DataFrame:
    """Children whose property names an area (case aside), not linked so far."""
    c = children.filter(valid_at()).select(F.col("id").alias("from_node_id"), F.lower(name).alias("k")).filter("k is not null")
    a = areas.filter(valid_at()).select(F.col("id").alias("to_node_id"), F.lower("label").alias("k")).filter("k is not null")
    return missing(c.join(a, "k").select("from_node_id", "to_node_id").distinct(), edges, "PART_OF")


def part_of_by_key(children: DataFrame, parents: DataFrame, edges: DataFrame, child_key: Column, parent_key: Column) -> DataFrame:
    c = children.filter(valid_at()).select(F.col("id").alias("from_node_id"), child_key.alias("k")).filter("k is not null")
    p = parents.filter(valid_at()).select(F.col("id").alias("to_node_id"), parent_key.alias("k")).filter("k is not null")
    return missing(c.join(p, "k").select("from_node_id", "to_node_id").distinct(), edges, "PART_OF")


def orphans(children: DataFrame, parents: DataFrame, child_key: Column, parent_key: Column) -> DataFrame:
    """Children that name a parent which isn't there: ``id, parent_key``."""
    p = parents.select(parent_key.alias("parent_key")).distinct()
    return children.select("id", child_key.alias("parent_key")).filter("parent_key is not null").join(p, "parent_key", "left_anti").select("id", "parent_key")


def link_confidence(found: DataFrame) -> DataFrame:
    """``found`` with ``confidence``: streets 0.9; an area 0.85 as the text's only mention, else 0.7."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("id")) == 1
    return found.withColumn("confidence", F.when(F.col("relation") == "mentions_street", STREET).when(alone, AREA_ALONE).otherwise(AREA_AMONG))


def text_links(texts: DataFrame, areas: DataFrame, streets: DataFrame | None = None, floor: float = FLOOR, max_words: int | None = None) -> DataFrame:
    """``from_node_id, to_node_id, term, relation, confidence`` of places named in current text nodes."""
    layers = [(areas.select(F.col("id").alias("ord"), "id", "label"), "mentions_area")]
    if streets is not None:
        layers.append((streets.select(F.col("id").alias("ord"), "id", "label"), "mentions_street"))
    # Ids order a layer here; ranks need numbers.
    ranked = [(rows.withColumn("ord", F.xxhash64("id")), relation) for rows, relation in layers]
    t = texts.filter(valid_at()).select("id", node_text(F.col("label"), F.col("properties")).alias("text"))
    m = link_confidence(mentions(t, gazetteer(ranked), max_words)).filter(F.col("confidence") >= floor)
    return m.select(F.col("id").alias("from_node_id"), F.col("node_id").alias("to_node_id"), "term", "relation", "confidence")
