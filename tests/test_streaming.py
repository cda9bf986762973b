from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.schema import NODES, conform
from tessera.storage import scratch
from tessera.streaming import ingest

T0 = datetime(2024, 1, 1)
DDL = "delivery_id bigint, k string, received_at timestamp"


def land(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)


def test_each_message_once(spark):
    src, store, out, check = (scratch(spark, n) for n in ("src", "store", "out", "check"))
    land(spark, src, [(1, "a", T0), (2, "a", T0), (3, None, T0)], DDL)

    def run():
        ingest.exactly_once(ingest.landed(spark, src, DDL, "parquet", 1), store, out, ["k"], "delivery_id", "received_at", check).awaitTermination()
        return sorted(r["delivery_id"] for r in spark.read.schema(DDL).parquet(f"{out}/*").collect())

    assert run() == [1, 3]
    land(spark, src, [(4, "a", T0), (5, "b", T0)], DDL)
    assert run() == [1, 3, 5]
    assert run() == [1, 3, 5]


def test_versions_by_micro_batches(spark):
    src, table, check = (scratch(spark, n) for n in ("nodes", "table", "check"))
    ddl = conform(spark.createDataFrame([], NODES), NODES).schema

    def batch(label, day):
        x = conform(spark.createDataFrame([("s", "a", label, "{}", datetime(2024, 1, day))], "source string, source_id string, label string, properties string, observed_at timestamp"), NODES)
        x.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
        ingest.upsert_stream(stream, table, check).awaitTermination()

    for label, day in (("A", 1), ("A", 2), ("B", 3)):
        batch(label, day)
    rows = ingest.current_table(spark, table).orderBy("valid_to").collect()
    assert [(r["label"], r["valid_to"]) for r in rows] == [("B", None), ("A", datetime(2024, 1, 3))]


def test_watermarked(spark):
    src = scratch(spark, "events")
    land(spark, src, [(1, "a", T0), (2, "a", T0), (3, "b", T0)], DDL)
    s = ingest.landed(spark, src, DDL, "parquet")
    for i, df in enumerate((ingest.once(s, ["k"], "received_at"), ingest.windowed_counts(s, "received_at", ["k"]))):
        q = df.writeStream.format("memory").queryName(f"mem{i}").outputMode("append" if i == 0 else "complete").option("checkpointLocation", scratch(spark, "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("mem0").count() == 2
    assert {(r["k"], r["count"]) for r in spark.table("mem1").select("k", F.col("count")).collect()} == {("a", 2), ("b", 1)}
