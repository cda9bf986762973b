"""Sources mixed to target shares of all tokens.

Entropy balancing. Of all expected numbers of copies r >= 0 that give each source its tokens and
none of its documents more than its cap, those nearest to one copy each (by relative entropy) are
r = min(cap, exp(lambda * tokens / mean)). The convex dual in lambda is solved by Newton steps;
each step is one distributed aggregate over the histogram of document sizes. Rates are rounded to
copies by a threshold on hashed fractions, chosen for each source so that its tokens are met to
within about one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tokens import count_tokens
from tessera.storage import load, materialise

BINS = 4096
ROUNDS = 80
TOLERANCE = 1e-9


def _per_source(values: dict[str, float], source: Column) -> Column:
    """A number for each source, as a literal map; null for sources without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))]), source)


def rate(tilt: Column, cap: Column, size: Column) -> Column:
    """min(cap, exp(tilt * size)), without overflow."""
    return F.least(cap, F.exp(F.least(tilt * size, F.lit(50.0))))


def solve(histogram: DataFrame, wanted: dict[str, float], caps: dict[str, int], mean: dict[str, float], most: dict[str, float]) -> tuple[dict[str, float], int]:
    """The tilt of each source by Newton's method on the dual, kept inside a bracket; and the number of steps.

    ``histogram``: ``source, tokens, n``. A source that needs (nearly) all its capped copies gets an
    infinite tilt, i.e. its cap for each document.
    """
    tilt = {s: 0.0 for s in wanted}
    done = {s for s in wanted if wanted[s] >= most[s] * (1 - 1e-12)}
    for s in done:
        tilt[s] = 1e6
    low, high = dict.fromkeys(wanted, -math.inf), dict.fromkeys(wanted, math.inf)
    steps = 0
    while steps < ROUNDS and len(done) < len(wanted):
        left = [s for s in wanted if s not in done]
        size = F.col("tokens") / _per_source(mean, F.col("source"))
        r = rate(_per_source(tilt, F.col("source")), _per_source(caps, F.col("source")), size)
        free = r < _per_source(caps, F.col("source"))
        got = histogram.filter(F.col("source").isin(left)).groupBy("source").agg(
            F.sum(F.col("n") * r * F.col("tokens")).alias("g"), F.sum(F.when(free, F.col("n") * r * F.col("tokens") * size).otherwise(0.0)).alias("h")
        ).collect()
        for row in got:
            s, g, h = row["source"], row["g"], row["h"]
            gap = wanted[s] - g
            if abs(gap) <= TOLERANCE * wanted[s]:
                done.add(s)
                continue
            if gap > 0:
                low[s] = tilt[s]
            else:
                high[s] = tilt[s]
            step = tilt[s] + gap / h if h > 0 else math.inf
            if not low[s] < step < high[s] or abs(step - tilt[s]) > 4:
                lo = low[s] if low[s] > -math.inf else tilt[s] - 4
                hi = high[s] if high[s] < math.inf else tilt[s] + 4
                step = (lo + hi) / 2 if low[s] > -math.inf and high[s] < math.inf else (hi if gap > 0 else lo)
            if abs(step - tilt[s]) < 1e-14:
                done.add(s)
            tilt[s] = step
        steps += 1
    return tilt, steps


def thresholds(rated: DataFrame, wanted: dict[str, float]) -> dict[str, float]:
    """For each source the priority below which a document gets one copy more, found in two rounds of ``BINS`` bins."""
    base = {r["source"]: r["t"] for r in rated.groupBy("source").agg(F.sum(F.col("base") * F.col("tokens")).alias("t")).collect()}
    low, width, have = dict.fromkeys(wanted, -1.0), 2.0, {s: float(base.get(s) or 0) for s in wanted}
    for _ in range(2):
        lo = _per_source(low, F.col("source"))
        at = F.floor((F.col("priority") - lo) / (width / BINS))
        bins = rated.filter(F.col("more") & (F.col("priority") >= lo) & (F.col("priority") < lo + width)).groupBy("source", at.alias("bin")).agg(F.sum("tokens").alias("t")).collect()
        by: dict[str, dict[int, float]] = {}
        for r in bins:
            by.setdefault(r["source"], {})[int(r["bin"])] = float(r["t"])
        for s in wanted:
            k = BINS - 1
            for b in sorted(by.get(s, {})):
                if have[s] + by[s][b] > wanted[s]:
                    k = b
                    break
                have[s] += by[s][b]
            low[s] += k * (width / BINS)
        width /= BINS
    return low


def mix(sizes: DataFrame, targets: list[tuple[str, float, int]], total_tokens: float | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Copies of each document, and the shares aimed at.

    ``sizes``: ``doc_id, source, tokens``. ``targets``: (source, share, most repeats); null sources,
    shares that are null or not positive and caps below 1 take no part. Of the sources that have
    tokens the shares are scaled to sum to one. ``total_tokens`` is the size of the mixture; by default
    the largest that all sources can fill to their shares within their caps. A source that can't fill its share of a
    given total gives all its capped copies. Documents of other sources, and of no tokens, get no copy.
    Result: ``doc_id, source, tokens, rate, copies``, a row for each row of ``sizes`` that is of a
    targeted source and has tokens.
    """
    spark = sizes.sparkSession
    shares, caps = {}, {}
    for s, share, cap in targets:
        if s is not None and share and share > 0 and cap and cap >= 1:
            shares[s], caps[s] = shares.get(s, 0.0) + float(share), int(cap)
    empty = "doc_id bigint, source string, tokens bigint, rate double, copies bigint"
    if not shares:
        return spark.createDataFrame([], empty), {}
    used = sizes.filter(F.col("source").isin(list(shares)) & (F.col("tokens") > 0))
    histogram = materialise(used.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "histogram")
    have = {r["source"]: r for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("t"), F.sum("n").alias("n")).collect()}
    shares = {s: v for s, v in shares.items() if s in have}
    if not shares:
        return spark.createDataFrame([], empty), {}
    whole = sum(shares.values())
    shares = {s: v / whole for s, v in shares.items()}
    most = {s: float(caps[s] * have[s]["t"]) for s in shares}
    total = float(total_tokens) if total_tokens else min(most[s] / shares[s] for s in shares)
    wanted = {s: min(most[s], shares[s] * total) for s in shares}
    mean = {s: have[s]["t"] / have[s]["n"] for s in shares}
    tilt, _ = solve(histogram, wanted, {s: caps[s] for s in shares}, mean, most)
    source = F.col("source")
    cap = _per_source({s: caps[s] for s in shares}, source)
    r = rate(_per_source(tilt, source), cap, F.col("tokens") / _per_source(mean, source))
    unit = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    x = used.filter(source.isin(list(shares))).withColumn("rate", r).withColumn("base", F.floor("rate").cast("long"))
    x = x.withColumns({"priority": unit - (F.col("rate") - F.col("base")), "more": F.col("base") < cap})
    cut = thresholds(x, wanted)
    copies = F.col("base") + F.when(F.col("more") & (F.col("priority") < _per_source(cut, source)), 1).otherwise(0)
    return x.select("doc_id", "source", "tokens", "rate", copies.cast("long").alias("copies")), shares


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float, int]]:
    rows = load(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").distinct().collect()
    return sorted((tuple(r) for r in rows), key=str)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, float]]:
    sizes = materialise(count_tokens(load(spark, sf_dir, "documents"), keep=("doc_id", "source")), "sizes")
    return mix(sizes, _targets(spark, sf_dir))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their numbers of copies."""
    return _mixed(spark, sf_dir)[0].filter("copies > 0").withColumn("rate", F.round("rate", 6))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, of either table: the share wanted, the share reached, tokens there and used, the most copies of a document."""
    sizes = materialise(count_tokens(load(spark, sf_dir, "documents"), keep=("doc_id", "source")), "sizes")
    targets = _targets(spark, sf_dir)
    mixed, aimed = mix(sizes, targets)
    there = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens_there"))
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    rows = [(s, float(share) if share is not None else None, aimed.get(s, 0.0)) for s, share, _ in targets]
    wanted = spark.createDataFrame(rows, "source string, target_share double, aimed_share double")
    used = materialise(used, "used")  # a row for each targeted source
    total = float(used.agg(F.sum("tokens_used")).first()[0] or 1)
    x = there.join(wanted, "source", "full").join(used, "source", "left")
    return x.select(
        "source", "target_share", F.round("aimed_share", 6).alias("aimed_share"), F.round(F.coalesce(F.col("tokens_used"), F.lit(0)) / total, 6).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens_there", F.lit(0)).alias("tokens_there"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
