"""Version-keeping writes without MERGE: a batch joined to the open versions.

All functions are pure: they return the new table; the caller writes it to a new place and swaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import node_id

KEY = ["source", "source_id"]


def content_hash(label: Column, properties: Column) -> Column:
    """SHA-256 of label and properties; properties of equal JSON content give equal hashes."""
    canonical = F.coalesce(F.to_json(F.try_parse_json(properties)), properties)
    return F.sha2(F.to_json(F.struct(label.alias("label"), canonical.alias("properties"))), 256)


def keyed(df: DataFrame) -> Column:
    return F.col("source_id").isNotNull() & (F.col("source_id") != "")


def last_in_batch(batch: DataFrame, order: list[str]) -> DataFrame:
    """Of rows with one key the last by ``order``; rows without key all stay."""
    have = batch.filter(keyed(batch))
    last = have.groupBy(*KEY).agg(F.max(F.struct(*order, *[c for c in batch.columns if c not in (*KEY, *order)])).alias("r")).select(*KEY, "r.*")
    return last.select(*batch.columns).unionByName(batch.filter(~keyed(batch) | F.col("source_id").isNull()))


def upsert_nodes(table: DataFrame, batch: DataFrame, now: Column, order: list[str] | None = None) -> DataFrame:
    """``table`` after the batch, with ``change``: untouched, touched, closed or inserted.

    A key's open version with the same content is touched (``observed_at`` = now), with other content
    closed (``valid_to`` = now) and a new version inserted. A row with null or empty source_id is
    always inserted. Several rows of one key in the batch count as their last by ``order`` (default observed_at).
    Geometry and validity aren't content. A batch that was applied before changes nothing but observed_at.
    """
    batch = last_in_batch(batch, order or ["observed_at"])
    incoming = batch.filter(keyed(batch)).withColumn("__h", content_hash(F.col("label"), F.col("properties")))
    keys = incoming.select(*KEY, "__h")
    old = table.join(keys, KEY, "left")
    is_open = F.col("valid_to").isNull() & F.col("__h").isNotNull()
    same = content_hash(F.col("label"), F.col("properties")) == F.col("__h")
    change = F.when(~is_open, "untouched").when(same, "touched").otherwise("closed")
    old = old.withColumn("change", change)
    old = old.withColumns({
        "observed_at": F.when(F.col("change") == "touched", now).otherwise(F.col("observed_at")),
        "valid_to": F.when(F.col("change") == "closed", now).otherwise(F.col("valid_to")),
    }).drop("__h")
    open_now = table.filter(F.col("valid_to").isNull()).select(*KEY, content_hash(F.col("label"), F.col("properties")).alias("__h"))
    fresh = incoming.join(open_now, [*KEY, "__h"], "left_anti").drop("__h")
    fresh = fresh.unionByName(batch.filter(~keyed(batch) | F.col("source_id").isNull()))
    # The version's id comes from what it is, so a second run makes the same row.
    fresh = fresh.withColumns({"observed_at": now, "id": node_id(F.col("source"), F.coalesce("source_id", F.lit("")), F.concat_ws("|", content_hash(F.col("label"), F.col("properties")), now.cast("string")))})
    return old.unionByName(fresh.withColumn("change", F.lit("inserted")).select(*old.columns))


def upsert_edges(table: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """``table`` after the batch, with ``change``: an open edge of the key is touched, else the edge is inserted.

    Content isn't compared and nothing is closed. Edges without source_id get one of their type and ends, so
    that a second run doesn't insert them again. Repeated keys of the batch count once.
    """
    ends = F.concat_ws(":", "edge_type", "from_node_id", "to_node_id")
    batch = batch.withColumn("source_id", F.coalesce(F.nullif(F.col("source_id"), F.lit("")), ends))
    one = batch.groupBy(*KEY).agg(F.max(F.struct("observed_at", *[c for c in batch.columns if c not in (*KEY, "observed_at")])).alias("r")).select(*KEY, "r.*").select(*batch.columns)
    hit = one.select(*KEY, F.lit(True).alias("__hit"))
    touched = F.col("__hit").isNotNull() & F.col("valid_to").isNull()
    old = table.join(hit, KEY, "left").withColumn("change", F.when(touched, "touched").otherwise("untouched"))
    old = old.withColumn("observed_at", F.when(F.col("change") == "touched", now).otherwise(F.col("observed_at"))).drop("__hit")
    fresh = one.join(table.filter(F.col("valid_to").isNull()).select(*KEY), KEY, "left_anti").withColumns({"observed_at": now, "change": F.lit("inserted")})
    return old.unionByName(fresh.select(*old.columns))


def more_than_one_open(table: DataFrame) -> DataFrame:
    """Keys that break the rule of one open version."""
    return table.filter(F.col("valid_to").isNull() & keyed(table)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("open")).filter("open > 1")


def unseen(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Items whose key hasn't been seen; null keys are always new."""
    return items.join(seen.select(key).distinct(), key, "left_anti")
