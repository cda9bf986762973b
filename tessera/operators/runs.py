"""The run log, checkpoints and the catalogue of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_run(runs: DataFrame) -> DataFrame:
    """The last started run of each connector; aggregated on the map side, without a window."""
    rest = [c for c in runs.columns if c not in ("connector", "started_at")]
    return runs.groupBy("connector").agg(F.max(F.struct("started_at", *rest)).alias("r")).select("connector", "r.*")


def latest_checkpoint(runs: DataFrame) -> DataFrame:
    """``connector, checkpoint`` of the last finished run that ended well; runs that failed don't count."""
    ok = runs.filter((F.col("status") == "ok") & F.col("finished_at").isNotNull())
    return ok.groupBy("connector").agg(F.max(F.struct("finished_at", "checkpoint")).alias("r")).select("connector", "r.checkpoint")


def started(runs: DataFrame, connector: str, now: Column) -> DataFrame:
    one = runs.sparkSession.range(1).select(F.lit(connector).alias("connector"), now.alias("started_at"), F.lit("running").alias("status"))
    return runs.unionByName(one, allowMissingColumns=True)


def finished(runs: DataFrame, connector: str, started_at: Column, now: Column, status: str, nodes: int = 0, edges: int = 0, checkpoint: str | None = None, error: str | None = None) -> DataFrame:
    hit = (F.col("connector") == connector) & (F.col("started_at") == started_at)
    put = {"finished_at": now, "status": F.lit(status), "nodes_written": F.lit(nodes), "edges_written": F.lit(edges), "checkpoint": F.lit(checkpoint), "error": F.lit(error)}
    return runs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()})


def source_status(catalogue: DataFrame, runs: DataFrame) -> DataFrame:
    """Every source with its last run, if it ever ran."""
    return catalogue.join(latest_run(runs).withColumnRenamed("connector", "name"), "name", "left")


def hourly(observations: DataFrame, at: str, by: list[str], values: list[str]) -> DataFrame:
    """Means by hour (``hour``) and key, with the number of observations; nulls don't enter a mean."""
    return observations.groupBy(*by, F.date_trunc("hour", F.col(at)).alias("hour")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])
