"""What all sources share: a declarative emit and landed files as input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schema import NODES, conform, node_id


def emit(raw: DataFrame, node_type: str | Column, source: str, source_id: Column, label: Column, properties: dict[str, Column], now: Column, url: Column | None = None, **more: Column) -> DataFrame:
    """Rows of the nodes table, one for each raw row. ``more``: valid_from, valid_to, lat, lon, rings.

    Properties become one JSON text in which unknown values are null. Labels have at most 200 characters.
    """
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    columns = {
        "id": node_id(F.lit(source), F.coalesce(source_id, F.lit(""))), "node_type": kind, "source": F.lit(source), "source_id": source_id, "source_url": F.lit(None).cast("string") if url is None else url,
        "label": F.substring(label, 1, 200), "properties": F.to_json(F.struct(*[c.alias(k) for k, c in properties.items()]), {"ignoreNullFields": "false"}) if properties else F.lit("{}"),
        "observed_at": now, "inferred": F.lit(False), **more,
    }
    return conform(raw.select(*[c.alias(k) for k, c in columns.items()]), NODES)


def part_of(children: DataFrame, child: str, parents: DataFrame, parent: str, source: str, now: Column) -> DataFrame:
    """PART_OF edges by an equality of keys; ``child`` and ``parent`` are column names."""
    p = parents.select(F.col(parent).alias("__k"), F.col("id").alias("to_node_id"))
    x = children.select(F.col(child).alias("__k"), F.col("id").alias("from_node_id")).join(p, "__k")
    return relation(x, "PART_OF", None, source, now)


def relation(pairs: DataFrame, edge_type: str, name: str | None, source: str, now: Column) -> DataFrame:
    """Edge rows of ``from_node_id, to_node_id``, with a source_id made of type and ends."""
    from tessera.schema import EDGES

    sid = F.concat_ws(":", F.lit(name or edge_type), "from_node_id", "to_node_id")
    props = F.to_json(F.struct(F.lit(name).alias("relation"))) if name else F.lit("{}")
    x = pairs.select("from_node_id", "to_node_id", F.lit(edge_type).alias("edge_type"), sid.alias("source_id"), F.sha2(sid, 256).alias("id"), props.alias("properties"), F.lit(source).alias("source"), now.alias("observed_at"), F.lit(False).alias("inferred"))
    return conform(x, EDGES)


def read_landed(spark: SparkSession, path: str, form: str, ddl: str | None = None, **options: str) -> DataFrame:
    """Landed files of a source. The schema is given, so nothing is read to infer it; without one (wide tables) the header names the columns."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(ddl) if ddl else reader).load(path)
