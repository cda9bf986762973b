"""Column layouts of the graph's tables and the names of its types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = (
    "id string, node_type string, label string, properties string, source string, source_id string, source_url string, observed_at timestamp, valid_from timestamp, valid_to timestamp, "
    "inferred boolean, confidence double, reasoning_trace string, lat double, lon double, rings array<array<array<double>>>"
)
EDGES = (
    "id string, edge_type string, from_node_id string, to_node_id string, properties string, source string, source_id string, source_url string, observed_at timestamp, "
    "valid_from timestamp, valid_to timestamp, inferred boolean, confidence double, reasoning_trace string"
)
RUNS = "connector string, started_at timestamp, finished_at timestamp, status string, nodes_written int, edges_written int, checkpoint string, error string"
CANDIDATES = "id string, node_a_id string, node_b_id string, method string, confidence double, resolved boolean, resolved_at timestamp, resolved_by string"
INSIGHTS = "id string, candidate_key string, insight_type string, title string, description string, confidence double, evidence_node_ids array<string>, status string, created_at timestamp"
TABLES = {"nodes": NODES, "edges": EDGES, "ingestion_runs": RUNS, "resolution_candidates": CANDIDATES, "insights": INSIGHTS}

# Type names of the model.
NODE_TYPES = (
    "GeoArea", "Organization", "Person", "Resolution", "Meeting", "AgendaItem", "POI", "Road", "ConstructionSite", "Tender", "Event", "WeatherObservation",
    "AirQualityObservation", "TransitStop", "TransitRoute",
)
EDGE_TYPES = ("LOCATED_IN", "VOTED_ON", "PASSED_BY", "RELATES_TO", "AWARDED_TO", "MEMBER_OF", "PART_OF", "SERVES", "MENTIONS", "SAME_AS")


def create_tables(spark: SparkSession, path: str) -> None:
    """Empty tables of the graph below ``path``; existing ones stay."""
    for name, ddl in TABLES.items():
        spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{path}/{name}")


def missing_tables(spark: SparkSession, path: str) -> list[str]:
    """Tables below ``path`` that aren't there or lack a column."""
    out = []
    for name, ddl in TABLES.items():
        try:
            there = set(spark.read.parquet(f"{path}/{name}").columns)
        except Exception:  # noqa: BLE001
            there = set()
        if not {c.split()[0] for c in ddl.split(", ")} <= there:
            out.append(name)
    return out


def node_id(source: Column, source_id: Column, version: Column | None = None) -> Column:
    """A deterministic id: the same entity version gets the same id in every run."""
    return F.sha2(F.concat_ws("|", source, source_id, *([version.cast("string")] if version is not None else [])), 256)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of a table, in its types; missing ones are null."""
    wanted = df.sparkSession.createDataFrame([], ddl).schema
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
