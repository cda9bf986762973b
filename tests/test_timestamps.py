from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.timestamps import offset_intervals, to_instants


def us(*parts) -> int:
    return int(datetime(*parts, tzinfo=UTC).timestamp() * 1_000_000)


CASES = [
    ("2023-10-22T11:52:05+02:00", us(2023, 10, 22, 9, 52, 5), "stated"),
    ("2023-04-08T23:57:48Z", us(2023, 4, 8, 23, 57, 48), "stated"),
    ("2023-08-09T09:40:55+0200", us(2023, 8, 9, 7, 40, 55), "stated"),
    ("2025-09-09T04:10+02:00", us(2025, 9, 9, 2, 10), "stated"),
    ("2025-11-04 19:38:10.866467+01:00", us(2025, 11, 4, 18, 38, 10) + 866467, "stated"),
    ("2023-05-28T16:16:54+02:00[Europe/Berlin]", us(2023, 5, 28, 14, 16, 54), "stated"),
    ("28.04.2024 12:27:32 MESZ", us(2024, 4, 28, 10, 27, 32), "stated"),
    ("2023-12-03 06:40:00 CET", us(2023, 12, 3, 5, 40), "stated"),
    ("Mon, 08 Dec 2025 00:00:00 +0100", us(2025, 12, 7, 23), "stated"),
    ("1739486316", 1739486316 * 1_000_000, "stated"),
    ("1716974297476 ", 1716974297476 * 1_000, "stated"),
    ("20250821T045622", us(2025, 8, 21, 2, 56, 22), "unique"),
    ("16. Februar 2024, 07:22 Uhr", us(2024, 2, 16, 6, 22), "unique"),
    ("5. März 2024, 05:19 Uhr", us(2024, 3, 5, 4, 19), "unique"),
    ("29.6.25 2:09", us(2025, 6, 29, 0, 9), "unique"),
    (" 2025-01-05T20:05:48\t", us(2025, 1, 5, 19, 5, 48), "unique"),
    ("29.10.2023, 02:56 Uhr", us(2023, 10, 29, 0, 56), "ambiguous"),
    ("31.3.24 2:15", us(2024, 3, 31, 1, 15), "skipped"),
    ("27.12.2024 24:00", us(2024, 12, 27, 23), "unique"),
    ("2024-06-31 10:15", None, None),
    ("2025-13-04T06:00:00Z", None, None),
    ("0000-00-00T00:00:00", None, None),
    ("01.01.2025 25:00", None, None),
    ("2025-01-01T00:00:00+99:00", None, None),
    (" " * 120 + "2024-02-28 10:00" + " " * 5000, us(2024, 2, 28, 9), "unique"),
    ("2024-02-28 10:00" + " " * 50_000 + "x", None, None),
    ("2024-02-28 10:00 America/New_York", us(2024, 2, 28, 15), "unique"),
    ("2024-11-03 01:30 America/New_York", us(2024, 11, 3, 5, 30), "ambiguous"),
    ("2024-02-28 10:00 America/Argentina/Buenos_Aires", us(2024, 2, 28, 13), "unique"),
    ("2024-02-28 10:00 Atlantis/Port", None, None),
    ("1700-05-05 12:00", us(1700, 5, 5, 11, 6, 32), "unique"),
    ("1895-07-01 12:00", us(1895, 7, 1, 11), "unique"),
    ("2500-07-01 12:00", us(2500, 7, 1, 10), "unique"),
    ("2500-03-28 02:30", us(2500, 3, 28, 1, 30), "skipped"),
    ("9999-12-31 23:00", us(9999, 12, 31, 22), "unique"),
    ("ab sofort", None, None),
    ("", None, None),
    (None, None, None),
    ("x" * 50_000, None, None),
]


def test_formats(spark):
    # Columns named like the operator's own are the caller's and stay.
    df = spark.createDataFrame([(i, t, "mine") for i, (t, _, _) in enumerate(CASES)], "i int, t string, spans string")
    rows = to_instants(df, F.col("t"), "Europe/Berlin").orderBy("i").collect()
    assert [(r["utc_us"], r["local_kind"]) for r in rows] == [(u, k) for _, u, k in CASES]
    assert {r["spans"] for r in rows} == {"mine"}


def test_date_with_time(spark):
    rows = [("Mo, 06.11.2023", "15:45:00", us(2023, 11, 6, 14, 45)), ("20240221", "18 Uhr", us(2024, 2, 21, 17)), ("2018-07-12T00:00:00", "17.15 Uhr", us(2018, 7, 12, 15, 15)), ("24.4.16", " 9:45 ", us(2016, 4, 24, 7, 45)),
            ("2019-04-08", "15:15:00+02:00", us(2019, 4, 8, 13, 15)), ("21. März 2021", "1615", us(2021, 3, 21, 15, 15)), ("2020-01-01", "13:00Z", us(2020, 1, 1, 13)), ("31.02.2024", "18:00", None), ("2019-02-15", None, None), (None, "18:00", None), ("2019-02-15", "nach Bedarf", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, b string, want bigint")
    assert to_instants(df, F.col("d"), "Europe/Berlin", F.col("b")).filter("not (utc_us <=> want)").count() == 0


def test_empty(spark):
    assert to_instants(spark.createDataFrame([], "t string"), F.col("t"), "UTC").count() == 0


@pytest.mark.parametrize("zone", ["Europe/Berlin", "UTC", "America/New_York"])
def test_intervals_agree_with_the_zone(zone):
    spans = offset_intervals(zone)
    tz = ZoneInfo(zone)

    @given(st.datetimes(datetime(1950, 1, 1), datetime(2090, 1, 1)))
    def check(local):
        s = (local - datetime(1970, 1, 1)).total_seconds()
        offsets = {off for ls, le, off in spans if ls <= s < le}
        real = set()
        for fold in (0, 1):
            off = local.replace(tzinfo=tz, fold=fold).utcoffset()
            if (local - off).replace(tzinfo=UTC).astimezone(tz).replace(tzinfo=None) == local:
                real.add(int(off / timedelta(seconds=1)))
        assert offsets == real

    check()
