"""Incremental loads with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import dedup, upsert
from tessera.storage import filesystem


def landed(spark: SparkSession, path: str, ddl: str, form: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """A stream over landed files; a backfill is taken in bounded bites."""
    return spark.readStream.format(form).schema(ddl).option("maxFilesPerTrigger", files_per_trigger).load(path)


def once(stream: DataFrame, key: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """Each key once within the watermark: bounded state. For exactness over all time use ``exactly_once``."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts by event-time window and key; rows later than the watermark are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *by).count()


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exactly_once(stream: DataFrame, store: str, out: str, keys: list[str], id_col: str, received: str, checkpoint: str) -> StreamingQuery:
    """Appends the first copy of each message to ``out``, whatever the time between copies."""

    def each(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces what it stored and wrote.
        dedup.ingest(batch, store, number, keys, id_col, received).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _run(stream, checkpoint, each)


def upsert_stream(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps versions: each micro-batch makes table version n+1 beside version n; ``current_table`` finds the newest."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current_table(spark, table_path, before=number)
        table = spark.createDataFrame([], batch.schema) if old is None else old
        new = upsert.upsert_nodes(table, batch, F.lit(batch.agg(F.max("observed_at")).first()[0]))
        new.drop("change").write.mode("overwrite").parquet(f"{table_path}/version={number}")

    return _run(stream, checkpoint, each)


def current_table(spark: SparkSession, table_path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (below ``before``), or None."""
    fs, p = filesystem(spark, table_path)
    if not fs.exists(p):
        return None
    done = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            done.append(int(name.split("=")[1]))
    done = [v for v in done if before is None or v < before]
    return spark.read.parquet(f"{table_path}/version={max(done)}") if done else None
