"""Readers of landed feeds: pages of JSON, RSS, archives of XML or CSV, and tables with comment lines.

Each file is a row of Spark's binary source and is opened on the executor that reads it. Schemas are given, so nothing
is read to infer them. Files that can't be read as what they should be give no rows; ``unreadable`` lists them.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RSS = "guid string, title string, link string, description string, pubDate string"
ROWS = 10_000  # rows of an archive's member handed on at a time


def json_pages(spark: SparkSession, path: str, item_ddl: str, items: str = "data") -> DataFrame:
    """Items of pages that hold them as the array ``items``; pages without it have none."""
    schema = T.StructType([T.StructField(items, T.ArrayType(spark.createDataFrame([], item_ddl).schema))])
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.inline(F.col(f"`{items}`")))


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS feeds, as the police source takes them."""
    return spark.read.format("xml").schema(RSS).option("rowTag", "item").load(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _members(content: bytes, suffix: str) -> Iterator[tuple[str, bytes]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(z.namelist()):
                if name.lower().endswith(suffix.lower()):
                    yield name, z.read(name)
    except zipfile.BadZipFile:
        return


def zip_texts(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """``file, xml``: each member of the archives whose name ends in ``suffix``, as the tender source takes them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                for name, data in _members(content, suffix):
                    yield pd.DataFrame({"file": [name], "xml": [data.decode("utf-8", "replace")]})

    return _files(spark, path).mapInPandas(read, "file string, xml string")


def zip_csv(spark: SparkSession, path: str, member: str, columns: tuple[str, ...]) -> DataFrame:
    """Columns of one table of the archives (of a timetable: ``stops.txt`` and others), all text; absent ones are empty."""
    ddl = ", ".join(f"`{c}` string" for c in columns)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                for name, data in _members(content, member):
                    if name.rsplit("/", 1)[-1].lower() != member.lower():
                        continue
                    rows = []
                    for r in csv.DictReader(io.StringIO(data.decode("utf-8-sig", "replace"), newline="")):
                        rows.append([r.get(c) or "" for c in columns])
                        if len(rows) == ROWS:
                            yield pd.DataFrame(rows, columns=list(columns))
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=list(columns))

    return _files(spark, path).mapInPandas(read, ddl)


def commented_csv(spark: SparkSession, path: str, first: str = "Datum", sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """A wide table whose header, a line that begins with the column ``first``, follows comment lines; all columns text.

    The header of the first file names the columns; a file with another header has other rows, which are left out.
    """
    text = F.decode("content", encoding)
    lines = _files(spark, path).select("path", F.posexplode(F.split(text, "\r?\n")).alias("at", "line"))
    heads = lines.filter(F.col("line").rlike(f'^"?{first}"?({sep}|$)'))
    top = heads.orderBy("path", "at").select("line").head(1)
    if not top:
        return spark.createDataFrame([], f"`{first}` string")
    names = next(csv.reader([top[0][0]], delimiter=sep))
    begin = heads.filter(F.col("line") == top[0][0]).groupBy("path").agg(F.min("at").alias("head"))  # a row for each file
    rows = lines.join(begin, "path").filter((F.col("at") > F.col("head")) & (F.trim("line") != ""))
    ddl = ", ".join(f"c{i} string" for i in range(len(names)))
    r = rows.select(F.from_csv("line", ddl, {"sep": sep}).alias("r"))
    return r.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)]).filter(F.coalesce(F.col(f"`{names[0]}`"), F.lit("")) != "")


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the files that are no archives."""
    return _files(spark, path).filter(F.substring("content", 1, 2) != F.lit(b"PK")).select("path")
