"""Where intermediate tables live, and how they are read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[app] = "file://" + folder
    return _LOCAL[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's part of the shared folder."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder, once its results have been taken."""
    fs, p = filesystem(spark, _own(spark))
    fs.delete(p, True)


def materialise(df: DataFrame, name: str, *partition_by: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.mode("errorifexists")
    writer = writer.option("compression", compression) if compression else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # given, since an empty table has no file to tell it


def drop(table: DataFrame) -> None:
    """Deletes a table that ``materialise`` wrote, once nothing reads it any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        fs, p = filesystem(spark, folder)
        fs.delete(p, True)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and ``path`` in its own class."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
