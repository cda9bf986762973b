"""Precision, recall and F1 of predicted against gold items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(gold: DataFrame, predicted: DataFrame, by: list[str], item: list[str]) -> DataFrame:
    """``by, tp, fp, fn``; repeated items count once. Examples that only one side knows are there too."""
    g, p = gold.select(*by, *item).distinct().withColumn("g", F.lit(1)), predicted.select(*by, *item).distinct().withColumn("p", F.lit(1))
    on = [*by, *item]
    x = g.join(p, on, "full")
    hit = F.col("g").isNotNull() & F.col("p").isNotNull()
    aggs = [F.count(F.when(hit, 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn")]
    return x.groupBy(*by).agg(*aggs)


def scores(c: DataFrame) -> DataFrame:
    """With precision, recall, f1 to four places. Nothing predicted or nothing to find is 1; no true positive has F1 0 unless both are 1."""
    p = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(1.0))
    r = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(1.0))
    f = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return c.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f, 4)})


def micro(c: DataFrame) -> DataFrame:
    """One row: the counts summed over all examples, then the scores."""
    return scores(c.agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in ("tp", "fp", "fn")]))
