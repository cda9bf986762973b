"""One UTC instant per row of the feeds whose times come in mixed formats and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.timestamps import to_instants
from tessera.storage import load

BERLIN = "Europe/Berlin"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feed, row_id, utc_us`` of each row that states a valid date and time."""
    # One pass over the union: autobahn and brightsky differ only in the zone meant where none is stated.
    a = load(spark, sf_dir, "autobahn").select(F.lit("autobahn").alias("feed"), F.col("delivery_id").alias("row_id"), F.col("startTimestamp").alias("stated"))
    b = load(spark, sf_dir, "brightsky").select(F.lit("brightsky").alias("feed"), F.col("obs_id").alias("row_id"), F.col("timestamp").alias("stated"))
    g = load(spark, sf_dir, "gremientermine").select(F.lit("gremientermine").alias("feed"), "row_id", "datum", "beginn")
    parts = [to_instants(a, F.col("stated"), BERLIN), to_instants(b, F.col("stated"), "UTC"), to_instants(g, F.col("datum"), BERLIN, F.col("beginn"))]
    rows = [x.select("feed", "row_id", "utc_us").filter("utc_us is not null") for x in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# Written apart from the operator: formats by their own patterns, German summer time by the rule of the
# last Sundays of March and October (which holds for the years in the data) instead of a zone table.
FOUND_SQL = r"""
WITH raw AS (
  SELECT 'autobahn' AS feed, delivery_id AS row_id, startTimestamp AS t, 'B' AS z FROM autobahn
  UNION ALL SELECT 'brightsky', obs_id, "timestamp", 'U' FROM brightsky
), months AS (
  SELECT * FROM (VALUES ('januar',1),('februar',2),('märz',3),('april',4),('mai',5),('juni',6),('juli',7),('august',8),('september',9),('oktober',10),('november',11),('dezember',12),
                        ('jan',1),('feb',2),('mar',3),('apr',4),('may',5),('jun',6),('jul',7),('aug',8),('sep',9),('oct',10),('nov',11),('dec',12)) m(name, num)
), g AS (
  SELECT 'gremientermine' AS feed, row_id, 'B' AS z,
         regexp_replace(trim(regexp_replace(datum, '^\w\w, ', '')), 'T.*$', '') AS d, trim(regexp_replace(beginn, '\s*Uhr', '')) AS b FROM gremientermine
), g2 AS (
  SELECT feed, row_id, z,
    CASE WHEN regexp_matches(d, '^\d{8}$') THEN d[1:4] || '-' || d[5:6] || '-' || d[7:8] ELSE d END AS d,
    CASE WHEN regexp_matches(b, '^\d{4}$') THEN b[1:2] || ':' || b[3:4] WHEN regexp_matches(b, '^\d{1,2}$') THEN b || ':00' WHEN regexp_matches(b, '^\d{1,2}\.\d\d$') THEN replace(b, '.', ':') ELSE b END AS b
  FROM g
), every AS (
  SELECT feed, row_id, z, regexp_replace(regexp_replace(t, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '\[.*\]$', '') AS t FROM raw
  UNION ALL SELECT feed, row_id, z, d || ' ' || b FROM g2 WHERE regexp_matches(b, '^\d{1,2}:\d\d')
), s AS (
  SELECT *, regexp_extract(t, '(Z|MESZ|MEZ|CEST|CET|[+-]\d\d:?\d\d)$', 1) AS zone FROM (SELECT * EXCLUDE t, CASE WHEN regexp_matches(t, '^\d+-\d+-\d+$') THEN NULL ELSE t END AS t FROM every)
), u AS (
  SELECT feed, row_id, z, zone, trim(regexp_replace(regexp_replace(t[1:length(t) - length(zone)], '\s*Uhr\s*$', ''), '^[A-Z][a-z]{1,2}, ', '')) AS t FROM s
), p AS (
  SELECT feed, row_id, z, zone, t,
    CASE WHEN regexp_matches(t, '^\d{4}-\d\d?-\d\d?[T ]+\d') THEN regexp_extract(t, '^(\d+)-(\d+)-(\d+)[T ]+(.*)$', ['y','m','d','c'])
         WHEN regexp_matches(t, '^\d{8}T\d{6}$') THEN {'y': t[1:4], 'm': t[5:6], 'd': t[7:8], 'c': t[10:11] || ':' || t[12:13] || ':' || t[14:15]}
         WHEN regexp_matches(t, '^\d\d?\.\d\d?\.\d+,? +\d') THEN regexp_extract(t, '^(?P<d>\d+)\.(?P<m>\d+)\.(?P<y>\d+),? +(?P<c>.*)$', ['d','m','y','c'])::STRUCT(y VARCHAR, m VARCHAR, d VARCHAR, c VARCHAR)
         WHEN regexp_matches(t, '^\d\d?\.? [[:alpha:]ä]+ \d{4},? +\d') THEN regexp_extract(t, '^(\d+)\.? ([[:alpha:]ä]+) (\d+),? +(.*)$', ['d','m','y','c'])::STRUCT(y VARCHAR, m VARCHAR, d VARCHAR, c VARCHAR) END AS f
  FROM u
), q AS (
  SELECT feed, row_id, z, zone, t,
    try_cast((CASE WHEN length(f.y) = 2 THEN '20' || f.y ELSE f.y END) || '-' || lpad(coalesce(num::VARCHAR, f.m), 2, '0') || '-' || lpad(f.d, 2, '0') AS DATE) AS day,
    try_cast(split_part(f.c, ':', 1) AS INT) AS h, try_cast(split_part(f.c, ':', 2) AS INT) AS mi,
    CASE WHEN split_part(f.c, ':', 3) = '' THEN 0 ELSE try_cast(split_part(split_part(f.c, ':', 3), '.', 1) AS INT) END AS sec,
    rpad(split_part(f.c, '.', 2), 6, '0')[1:6]::BIGINT AS us
  FROM p LEFT JOIN months ON lower(f.m) = name
), r AS (
  SELECT feed, row_id, z, zone, t, year(day) AS y,
    CASE WHEN h < 24 AND mi < 60 AND sec < 60 OR h = 24 AND mi = 0 AND sec = 0 THEN (epoch_us(day) + ((h * 60 + mi) * 60 + sec)::BIGINT * 1000000 + us)::BIGINT END AS loc
  FROM q
), dst AS (
  SELECT y::BIGINT AS y, epoch_us((make_date(y, 3, 31) - isodow(make_date(y, 3, 31))::INT % 7)::TIMESTAMP + INTERVAL 1 HOUR) AS on_us,
         epoch_us((make_date(y, 10, 31) - isodow(make_date(y, 10, 31))::INT % 7)::TIMESTAMP + INTERVAL 1 HOUR) AS off_us
  FROM (SELECT unnest(range(1997, 2101))::INT AS y)
), v AS (
  SELECT feed, row_id,
    CASE WHEN regexp_matches(t, '^\d{10}$') THEN t::BIGINT * 1000000 WHEN regexp_matches(t, '^\d{13}$') THEN t::BIGINT * 1000
         WHEN zone IN ('Z') OR zone = '' AND z = 'U' THEN loc
         WHEN zone IN ('MEZ', 'CET') THEN loc - 3600000000 WHEN zone IN ('MESZ', 'CEST') THEN loc - 7200000000
         WHEN zone <> '' THEN loc - (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * (zone[2:3]::BIGINT * 60 + right(zone, 2)::BIGINT) * 60000000
         WHEN loc - 7200000000 >= on_us AND loc - 7200000000 < off_us THEN loc - 7200000000
         ELSE loc - 3600000000 END AS utc_us
  FROM r LEFT JOIN dst USING (y)
)
SELECT feed, row_id, utc_us FROM v WHERE utc_us IS NOT NULL
"""
