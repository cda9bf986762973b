"""Exactly one copy of messages that were delivered at least once.

Deliveries are first combined by (time bucket, message), so a message that holds a third of all
rows shrinks on the map side. These combined rows are the bucketed storage, a folder for each time
bucket. Each bucket has a blocked Bloom filter, one 64-bit word a block, stored beside it. Only a
message's 64-bit hash travels to the filters: a message whose bits are missing in every other
bucket's filter is definitely new and its storage row isn't looked at again. What remains, pairs of
a hash and a bucket that may hold it, selects the storage rows that are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.timestamps import trimmed
from tessera.storage import filesystem, load, materialise

KEYS_PER_WORD = 4
BITS_PER_KEY = 4
BUCKET_DAYS = 120


def with_bits(df: DataFrame, words: Column | int) -> DataFrame:
    """Adds the block ``__word`` and the ``__mask`` of a message's bits, both from its hash ``__h``."""
    # The bits come from a second hash, so they are independent of the block.
    g = F.xxhash64(F.lit("bits"), "__h")
    mask = F.lit(0).cast("long")
    for i in range(BITS_PER_KEY):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return df.withColumns({"__word": F.pmod("__h", F.lit(words).cast("long")), "__mask": mask})


def bloom_filters(storage: DataFrame, words: int) -> DataFrame:
    """``__tb, __word, bits``: every time bucket's filter, a row for each of its blocks that isn't empty."""
    return with_bits(storage.select("__tb", "__h"), words).groupBy("__tb", "__word").agg(F.bit_or("__mask").alias("bits"))


def probe(hashes: DataFrame, filters: DataFrame, words: int) -> DataFrame:
    """``__h, own, __tb``: the time buckets, other than its own, whose filter may hold a hash; ``hashes``: ``__h, own`` (null: none is its own)."""
    by_word = filters.groupBy("__word").agg(F.collect_list(F.struct("__tb", "bits")).alias("__filters"))  # a row for each time bucket at most
    asked = with_bits(hashes, words).join(by_word, "__word")
    hits = F.filter("__filters", lambda f: ~f["__tb"].eqNullSafe(F.col("own")) & (f["bits"].bitwiseAND(F.col("__mask")) == F.col("__mask")))
    return asked.select("__h", "own", F.explode(F.transform(hits, lambda f: f["__tb"])).alias("__tb"))


def in_storage(deliveries: DataFrame, keys: list[str], id_col: str, received: str, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """One row per (time bucket, message): its hash, its number of deliveries and the earliest of them."""
    tb = F.floor(F.unix_seconds(F.coalesce(F.col(received), F.timestamp_seconds(F.lit(0)))) / (bucket_days * 86_400))
    usable = deliveries
    for k in keys:
        usable = usable.filter(F.col(k).isNotNull())
    # A delivery without a time of receipt comes after all that have one.
    order = F.struct(F.col(received).isNull().alias("late"), F.col(received).alias("at"), F.col(id_col).alias("id"))
    g = usable.withColumn("__tb", tb).groupBy("__tb", *keys).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    return g.select("__tb", *keys, F.xxhash64(*keys).alias("__h"), "__n", "__first")


def filter_words(storage: DataFrame) -> int:
    """Blocks for the fullest time bucket."""
    most = storage.groupBy("__tb").count().agg(F.max("count")).first()[0] or 1
    return max(1, most // KEYS_PER_WORD)


def surplus(deliveries: DataFrame, keys: list[str], id_col: str, received: str, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """The surplus deliveries: every copy of a message but its first by (``received``, ``id_col``).

    Returns ``deliveries``' rows and columns. Rows with a null in any of ``keys`` are never copies.
    An empty table gives an empty one; a null ``received`` comes last; of rows that agree in
    ``received`` and ``id_col`` too, all are the first copy and none is surplus. The join to the few repeated messages
    is on the message, one row per message on one side, so a hot message's rows are split by
    adaptive execution.
    """
    storage = materialise(in_storage(deliveries, keys, id_col, received, bucket_days), "messages", "__tb")
    firsts = _repeated(storage, keys).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__first.id").alias("__first_id"))
    on = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    return deliveries.join(firsts, on).filter(F.col(id_col) != F.col("__first_id")).select(*deliveries.columns)


def _repeated(storage: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, __first`` of every message delivered more than once."""
    words = filter_words(storage)
    hit = probe(storage.select("__h", F.col("__tb").alias("own")), materialise(bloom_filters(storage, words), "filters"), words)
    # Either side of a hit is a possible repeat: the row that asked, and the one in the bucket that may hold it.
    maybe = materialise(hit.select("__h", F.explode(F.array("own", "__tb")).alias("__tb")).distinct(), "maybe")
    compared = storage.join(maybe, ["__tb", "__h"], "left_semi")
    # What is repeated within one bucket only needs no comparison: no other bucket's filter holds it.
    alone = storage.filter("__n > 1").join(maybe, ["__tb", "__h"], "left_anti")
    several = compared.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.min("__first").alias("__first")).filter("__n > 1")
    return several.select(*keys, "__first").unionByName(alone.select(*keys, "__first"))


def unique_messages(deliveries: DataFrame, keys: list[str], id_col: str, received: str) -> DataFrame:
    """Exactly one copy of each message, and every row without a complete identifier.

    Of rows that agree in ``received`` and ``id_col`` too, one stays, the least by its other columns' hash.
    """
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    kept = deliveries.filter(complete).join(surplus(deliveries, keys, id_col, received).select(id_col), id_col, "left_anti")
    # Only rows with one identifier and one id are left beside each other: repeats of a single delivery.
    one = kept.groupBy(*[F.col(k).alias(f"__u{i}") for i, k in enumerate(keys)], F.col(id_col).alias("__id")).agg(F.min_by(F.struct(*deliveries.columns), F.struct(F.col(received).isNull(), F.col(received), F.xxhash64(*deliveries.columns))).alias("__r"))
    return one.select("__r.*").unionByName(deliveries.filter(~complete))


FILTER_WORDS = 1 << 18  # blocks of a stored bucket's filter (2 MB), good for a million messages; beyond, more is compared exactly


def ingest(batch: DataFrame, store_path: str, number: int, keys: list[str], id_col: str, received: str, bucket_days: int = BUCKET_DAYS, words: int = FILTER_WORDS) -> DataFrame:
    """Batch ``number`` against the storage of the batches below it: returns the rows that are new and stores them.

    The stored filters screen the batch; only possible repeats are looked up, and only in the folders of the buckets
    whose filters may hold them. The new messages and their share of the filters are written beside what is there, which
    isn't touched. A batch that is run again replaces what it stored and returns the same rows. Rows without a complete
    identifier are always new. ``words`` must be the same for all batches of a store.
    """
    spark = batch.sparkSession
    fresh = materialise(in_storage(batch, keys, id_col, received, bucket_days), "batch")
    hits = stored_hits(spark, fresh, store_path, number, words)
    known = fresh.limit(0).select(*keys)
    if hits is not None:
        hits = materialise(hits, "hits")
        buckets = [r[0] for r in hits.select("__tb").distinct().collect()]  # as many as there are time buckets
        known = look_up(spark, fresh.schema, store_path, number, buckets, hits).select(*keys).distinct()
    new = fresh.join(known, keys, "left_anti").groupBy("__h", *keys).agg(F.min("__first").alias("__first"), F.sum("__n").alias("__n"), F.min("__tb").alias("__tb"))
    new = new.select("__tb", *keys, "__h", "__n", "__first")
    new.write.mode("overwrite").partitionBy("__tb").parquet(f"{store_path}/messages/batch={number}")
    mine = spark.read.schema(new.schema).parquet(f"{store_path}/messages/batch={number}")
    bloom_filters(mine, words).write.mode("overwrite").partitionBy("__tb").parquet(f"{store_path}/filters/batch={number}")
    firsts = mine.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__first.id").alias("__first_id"))
    kept = batch.join(firsts, [F.col(k) == F.col(f"__k_{k}") for k in keys] + [F.col(id_col) == F.col("__first_id")], "left_semi").dropDuplicates([*keys, id_col])
    without = batch.filter(" or ".join(f"`{k}` is null" for k in keys))
    return materialise(kept.unionByName(without), "ingested")


def _below(spark, path: str, number: int, schema) -> DataFrame | None:
    fs, p = filesystem(spark, path)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path).filter(F.col("batch") < number) if fs.exists(p) else None


def stored_hits(spark, fresh: DataFrame, store_path: str, number: int, words: int) -> DataFrame | None:
    """``__h, __tb``: the stored buckets that may hold a message of the batch; None where nothing is stored. Reads filters alone."""
    filters = _below(spark, f"{store_path}/filters", number, bloom_filters(fresh, words).schema)
    if filters is None:
        return None
    whole = filters.groupBy("__tb", "__word").agg(F.bit_or("bits").alias("bits"))
    return probe(fresh.select("__h", F.lit(None).cast("long").alias("own")).distinct(), whole, words).select("__h", "__tb")


def look_up(spark, schema, store_path: str, number: int, buckets: list[int], hits: DataFrame) -> DataFrame:
    """The stored messages of the named buckets that hits point to; the folders of other buckets aren't read."""
    stored = _below(spark, f"{store_path}/messages", number, schema)
    return stored.filter(F.col("__tb").isin(buckets)).join(hits, ["__tb", "__h"], "left_semi")


def found(spark, sf_dir: str) -> DataFrame:
    """Surplus deliveries of ``autobahn`` (identifier) and ``edge_feed`` (source, source_id, observed_at)."""
    a = load(spark, sf_dir, "autobahn").select(
        F.lit("autobahn").alias("feed"), "delivery_id", "received_at", trimmed(F.col("identifier")).alias("k1"), F.lit("").alias("k2"), F.lit(0).cast("long").alias("k3")
    )
    e = load(spark, sf_dir, "edge_feed").select(
        F.lit("edge_feed").alias("feed"), "delivery_id", "received_at", F.col("source_id").alias("k1"), F.coalesce("source", F.lit("\0")).alias("k2"), F.coalesce(F.unix_micros("observed_at"), F.lit(-(2**62))).alias("k3")
    )
    return surplus(a.unionByName(e), ["feed", "k1", "k2", "k3"], "delivery_id", "received_at").select("feed", "delivery_id")


FOUND_SQL = """
WITH m AS (
  SELECT 'autobahn' AS feed, delivery_id, received_at,
         regexp_replace(identifier, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS k1, NULL AS k2, NULL::TIMESTAMPTZ AS k3
  FROM autobahn WHERE identifier IS NOT NULL
  UNION ALL
  SELECT 'edge_feed', delivery_id, received_at, source_id, source, observed_at::TIMESTAMPTZ FROM edge_feed WHERE source_id IS NOT NULL
), r AS (SELECT *, row_number() OVER (PARTITION BY feed, k1, k2, k3 ORDER BY received_at NULLS LAST, delivery_id) AS n FROM m)
SELECT feed, delivery_id FROM r WHERE n > 1
"""
