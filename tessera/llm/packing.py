"""Texts packed whole into containers of fixed capacity.

Bounded-space online best-fit. Each task keeps a fixed number of open bins and a bitset of their
free spaces: bit f is set while some open bin has f tokens free. The smallest bit not below an
item's size is the best fit, found by one shift; if there is none and all places are taken, the
fullest bin (lowest set bit) closes first. Items come in the order of a hash, so a task that is
run again builds the same bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tokens import count_tokens
from tessera.storage import load, materialise

OPEN_BINS = 256
ITEMS_PER_TASK = 50_000


class BestFit:
    """Open bins of one capacity."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # the bitset
        self.bins: dict[int, list[int]] = {}  # free space -> open bins
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        held = self.bins[space]
        b = held.pop()
        if not held:
            del self.bins[space]
            self.free &= ~(1 << space)
        return b

    def _put(self, b: int, space: int) -> None:
        self.bins.setdefault(space, []).append(b)
        self.free |= 1 << space

    def place(self, size: int) -> int:
        """The bin an item of at most the capacity goes into."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.open -= 1
            b, space = self.made, self.capacity
            self.made += 1
            self.open += 1
        if space == size:
            self.open -= 1  # full: nothing but empty items could follow
        else:
            self._put(b, space - size)
        return b


SCHEMA = "container string, capacity_tokens int, bin_id bigint, doc_id string, piece int, n_pieces int, tokens bigint, token_start bigint"


def pack(sizes: DataFrame, limits: list[tuple[str, int]], open_bins: int = OPEN_BINS, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """The columns of ``SCHEMA`` (``doc_id`` bigint): one row per item and container, or per piece of an item larger than the capacity.

    ``sizes``: ``doc_id, tokens``. An item larger than the capacity is cut into pieces of the capacity,
    each a bin of its own, and the rest is packed like an item. Items of size 0 go into a bin too, so
    every row of ``sizes`` comes out, repeated rows as often as they stand there. Rows with a null size
    count as size 0. Capacities that are null or not positive take nothing.
    """
    limits = [(c, int(k)) for c, k in limits if k and k > 0]
    spark = sizes.sparkSession
    if not limits:
        return spark.createDataFrame([], SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))
    # As text, since a null would turn a batch's ids into floating-point numbers. Repeats of a row are counted, where most combine
    # before any shuffle, and numbered by the thousand, so that they spread over the tasks and get the same places in every run.
    n = sizes.groupBy(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("tokens", F.lit(0)).alias("tokens")).agg(F.count(F.lit(1)).alias("n"))
    blocks = n.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1000).cast("long"))).alias("at"))
    written = materialise(blocks.select("doc_id", "tokens", F.explode(F.sequence("at", F.least(F.col("n") - 1, F.col("at") + 999))).alias("nth")), "sizes")
    tasks = max(1, -(-written.count() // items_per_task))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = None
        for b in batches:
            if bins is None:
                first = int(b["part"].iloc[0]) << 36
                bins = [(name, cap, BestFit(cap, open_bins)) for name, cap in limits]
            rows = []
            for doc, size in zip(b["doc_id"], b["tokens"], strict=True):
                for name, cap, fit in bins:
                    whole, rest = divmod(int(size), cap)
                    parts = whole + (rest > 0 or whole == 0)
                    for i in range(whole):
                        rows.append((name, cap, first + fit.made, doc, i, parts, cap, i * cap))
                        fit.made += 1
                    if parts > whole:
                        rows.append((name, cap, first + fit.place(rest), doc, whole, parts, rest, whole * cap))
                if len(rows) > 100_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    s = written.select("doc_id", "tokens", "nth").withColumn("order", F.xxhash64("doc_id", "tokens", "nth"))
    s = s.withColumn("part", F.pmod(F.xxhash64("order", F.lit("part")), F.lit(tasks)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A partition may hold several parts, one after the other: each is packed by itself.
        def parts() -> Iterator[tuple[int, pd.DataFrame]]:
            for b in batches:
                for part, rows in b.groupby("part", sort=False):
                    yield part, rows

        held: list[pd.DataFrame] = []
        at = None
        for part, rows in parts():
            if at is not None and part != at:
                yield from run(iter(held))
                held = []
            at = part
            held.append(rows)
        if held:
            yield from run(iter(held))

    return s.repartition(tasks, "part").sortWithinPartitions("part", "order", "doc_id", "nth").mapInPandas(each, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))


def document_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the containers of ``pack_limits``."""
    limits = [(r["container"], r["capacity_tokens"]) for r in load(spark, sf_dir, "pack_limits").distinct().collect()]
    return pack(count_tokens(load(spark, sf_dir, "documents")), sorted(limits, key=str))


def fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container: bins, tokens, and the share of the space that is filled."""
    b = document_bins(spark, sf_dir).groupBy("container", "capacity_tokens", "bin_id").agg(F.sum("tokens").alias("tokens"))
    return b.groupBy("container", "capacity_tokens").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")).withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6))
