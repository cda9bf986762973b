"""Reads of the property graph: lists, history, neighbourhoods and subgraphs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.temporal import valid_at
from tessera.functions.text import set_similarity, trigrams

PAGE, PAGE_MOST = 50, 500
LAYER, LAYER_MOST = 2000, 10_000


def endpoints(edges: DataFrame, *keep: str) -> DataFrame:
    """One row per edge and distinct endpoint (``node_id``, ``other_id``): a self-loop has one.

    Instead of a join on ``from = id OR to = id``, which no hash join can serve.
    """
    a, b = F.struct(F.col("from_node_id").alias("node_id"), F.col("to_node_id").alias("other_id")), F.struct(F.col("to_node_id").alias("node_id"), F.col("from_node_id").alias("other_id"))
    return edges.select(*keep, F.explode(F.array_distinct(F.array(a, b))).alias("e")).select(*keep, "e.node_id", "e.other_id")


def semi(df: DataFrame, on: str, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose ``on`` is among ``ids``."""
    k = ids.select(F.col(key).alias("__k")).distinct()
    return df.join(k, F.col(on) == F.col("__k"), "left_semi")


class Graph:
    """Nodes and edges (see ``schema``) with the queries on them. Each method returns a DataFrame and runs nothing."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def list_nodes(self, node_type: str | None = None, source: str | None = None, as_of: datetime | str | None = None, limit: int | None = PAGE, offset: int = 0) -> DataFrame:
        """Nodes valid at a time, newest first (ties by id); ``limit`` None for all."""
        x = self.nodes.filter(valid_at(as_of))
        if node_type is not None:
            x = x.filter(F.col("node_type") == node_type)
        if source is not None:
            x = x.filter(F.col("source") == source)
        if limit is None:
            return x
        if not 0 <= limit <= PAGE_MOST:
            raise ValueError(f"limit must be within 0 and {PAGE_MOST}")
        return x.orderBy(F.desc("observed_at"), "id").offset(offset).limit(limit)

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def feature_collection(self, node_type: str | None = None, source: str | None = None, as_of: str | None = None, limit: int | None = LAYER) -> DataFrame:
        """``collection``: one GeoJSON FeatureCollection of the nodes that have a geometry, the newest ``limit`` (at most ``LAYER_MOST``)."""
        if limit is None or not 0 <= limit <= LAYER_MOST:
            raise ValueError(f"limit must be within 0 and {LAYER_MOST}")  # it is one row
        x = self.nodes.filter(valid_at(as_of)).withColumn("__f", geo.feature(F.col("lon"), F.col("lat"), F.col("rings"), id=F.col("id"), node_type=F.col("node_type"), label=F.col("label"), source=F.col("source"))).filter("__f is not null")
        for column, value in (("node_type", node_type), ("source", source)):
            x = x if value is None else x.filter(F.col(column) == value)
        top = x.orderBy(F.desc("observed_at"), "id").limit(limit).agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("observed_at")).alias("at"), "id", "__f"))).alias("fs"))
        return top.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("fs.__f", ","), F.lit("]}")).alias("collection"))

    def nodes_by_ids(self, ids: DataFrame, key: str = "id") -> DataFrame:
        return semi(self.nodes, "id", ids, key)

    def history(self, source: str | None = None, source_id: str | None = None) -> DataFrame:
        """All versions in the order of their start, an unknown start first."""
        x = self.nodes
        if source is not None:
            x = x.filter(F.col("source") == source)
        if source_id is not None:
            x = x.filter(F.col("source_id") == source_id)
        return x.orderBy("source", "source_id", F.asc_nulls_first("valid_from"), "observed_at")

    def incident(self, ids: DataFrame, direction: str = "both", as_of: datetime | str | None = None) -> DataFrame:
        """Edges into, out of, or at the given nodes, valid at a time."""
        e = self.edges.filter(valid_at(as_of))
        into, out = semi(e, "to_node_id", ids), semi(e, "from_node_id", ids)
        if direction == "in":
            return into
        if direction == "out":
            return out
        if direction != "both":
            raise ValueError("direction must be in, out or both")
        return out.unionByName(into).dropDuplicates(["id"])

    def induced(self, ids: DataFrame, include_inferred: bool = True) -> DataFrame:
        """Current edges with both ends among the ids."""
        e = self.edges.filter(valid_at())
        e = e if include_inferred else e.filter(~F.col("inferred"))
        return semi(semi(e, "from_node_id", ids), "to_node_id", ids)

    def touching(self, ids: DataFrame) -> DataFrame:
        """Current source-fact edges with either end among the ids, each once."""
        e = self.edges.filter(valid_at() & ~F.col("inferred"))
        at = semi(endpoints(e, "id"), "node_id", ids).select("id").distinct()
        return e.join(at, "id", "left_semi")

    def neighbours(self, ids: DataFrame) -> DataFrame:
        """``node_id, other_id``: distinct neighbours over current source-fact edges."""
        return semi(endpoints(self.edges.filter(valid_at() & ~F.col("inferred"))), "node_id", ids).distinct()

    def degree(self) -> DataFrame:
        """``node_id, degree`` of current nodes over current source-fact edges; a self-loop counts once."""
        ends = endpoints(self.edges.filter(valid_at() & ~F.col("inferred"))).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
        return ends.join(self.nodes.filter(valid_at()).select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")

    def hubs(self, least: int = 3, limit: int = 50) -> DataFrame:
        return self.degree().filter(F.col("degree") >= least).orderBy(F.desc("degree"), "node_id").limit(limit)

    def located_in(self, area_id: str | None = None) -> DataFrame:
        """Current nodes with the areas they lie in (``area_id``), a row per edge."""
        e = self.edges.filter(valid_at() & (F.col("edge_type") == "LOCATED_IN"))
        e = e if area_id is None else e.filter(F.col("to_node_id") == area_id)
        return self.nodes.filter(valid_at()).join(e.select(F.col("from_node_id").alias("id"), F.col("to_node_id").alias("area_id")), "id")

    def search(self, query: str, least: float = 0.3, limit: int = 20) -> DataFrame:
        """Current nodes by trigram similarity of the label, best first (ties by id).

        Labels that share no trigram with the query can't reach any threshold above 0, so only the
        labels' trigrams that the query has are counted.
        """
        q = trigrams(F.lit(query))
        sim = set_similarity(F.col("grams"), q)
        x = self.nodes.filter(valid_at()).select("id", "node_type", "label", trigrams(F.col("label")).alias("grams")).withColumn("similarity", sim)
        return x.filter(F.col("similarity") >= least).drop("grams").orderBy(F.desc("similarity"), "id").limit(limit)


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group. The window keeps a running count, so a group's rest is never held; Spark cuts groups before the shuffle too."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")
