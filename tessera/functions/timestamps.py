"""Mixed timestamp texts to one UTC instant.

Parsing stays in built-in expressions: each family of formats is one pattern whose groups are
rewritten into ``y|mo|d|h|mi|s|fraction|zone`` and split once. Local times are then joined as-of
to zone-offset intervals exploded by month: two matching intervals mean the local time occurs
twice, none means it was skipped, one gives the offset. The interval table has one row per zone
and month of 1800-2437 (7,656 rows per zone, and at most as many zones as the time zone database
has: a bound that no data can change), so it is broadcast. Earlier times have their zone's first
offset; later ones are moved back by 400 years, after which the calendar and the rules repeat.
"""

from __future__ import annotations

import functools
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1800, 2437
CYCLE_YEARS, CYCLE_US = 400, 146_097 * 86_400_000_000
HOUR_US = 3_600_000_000

# Month names and their abbreviations, German and English.
MONTHS = {
    "januar": 1, "februar": 2, "märz": 3, "april": 4, "mai": 5, "juni": 6,
    "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12,
    "january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "october": 10, "december": 12,
    "jan": 1, "jän": 1, "jänner": 1, "feb": 2, "mar": 3, "mär": 3, "mrz": 3, "maerz": 3, "apr": 4, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}
# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "cet": 60, "mez": 60, "cest": 120, "mesz": 120}

_ZONE = r"\s*(Z|UTC|GMT|UT|CET|CEST|MEZ|MESZ|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)?(?:\[[^\]]*\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
# (pattern, rewriting) by family; anchored, case-insensitive.
_FAMILIES = (
    (rf"(?i)^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:T|\s+){_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"(?i)^(?:[a-zäöü]{{2,10}}\.?,\s*)?(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),?\s+{_CLOCK}(?:\s*Uhr)?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"(?i)^(?:[a-zäöü]{{2,10}}\.?,\s*)?(\d{{1,2}})\.?\s+([a-zäöü]{{3,9}})\.?\s+(\d{{4}}),?\s+{_CLOCK}(?:\s*Uhr)?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8"),
)
_DATES = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T\s].*)?$", "$1|$2|$3"),
    (r"^(\d{4})(\d{2})(\d{2})(?:T\d*)?$", "$1|$2|$3"),
    (r"(?i)^(?:[a-zäöü]{2,10}\.?,\s*)?(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$", "$3|$2|$1"),
    (r"(?i)^(?:[a-zäöü]{2,10}\.?,\s*)?(\d{1,2})\.?\s+([a-zäöü]{3,9})\.?\s+(\d{4})$", "$3|$2|$1"),
)
_TIMES = (
    (rf"(?i)^{_CLOCK}(?:\s*Uhr)?{_ZONE}$", "$1|$2|$3|$4|$5"),
    (rf"(?i)^(\d{{1,2}})\.(\d{{2}})(?:\s*Uhr)?{_ZONE}$", "$1|$2|||$3"),
    (rf"(?i)^(\d{{2}})(\d{{2}})(?:\s*Uhr)?{_ZONE}$", "$1|$2|||$3"),
    (rf"(?i)^(\d{{1,2}})\s*Uhr(?:\s+(\d{{2}}))?{_ZONE}$", "$1|$2|||$3"),
)


def trimmed(c: Column) -> Column:
    """Without white space of any kind around it; in time linear in the text, however much white space is within."""
    return F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")


def _rewrite(text: Column, families: tuple) -> Column:
    out = F.lit(None).cast("string")
    for pattern, groups in reversed(families):
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, groups)).otherwise(out)
    return F.split(out, r"\|", -1)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda variable isn't inlined."""
    return F.transform(F.array(value), use)[0]


def _rewrite_of(text: Column, families: tuple) -> Column:
    return _let(text, lambda t: _rewrite(t, families))


def _number(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")).try_cast("long"), F.lit(0))


def _epoch_day(y: Column, mo: Column, d: Column) -> Column:
    """Days since 1970, null for a date that doesn't exist; two-digit years are of this century."""
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.when(mo.rlike(r"^\d+$"), mo).otherwise(F.try_element_at(names, F.lower(mo)).cast("string"))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    return F.unix_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")).cast("long")


def _of_day_us(h: Column, mi: Column, s: Column, frac: Column) -> Column:
    """Microseconds of the day, null outside 00:00:00-24:00:00; digits beyond microseconds are cut.

    24:00 is the midnight that ends the day.
    """
    h, mi, s = _number(h), _number(mi), _number(s)
    us = _number(F.substring(F.rpad(F.coalesce(frac, F.lit("")), 6, "0"), 1, 6))
    whole = ((h * 60 + mi) * 60 + s) * 1_000_000 + us
    return F.when((h <= 24) & (mi < 60) & (s < 60) & (whole <= 24 * HOUR_US), whole)


def _offset_us(zone: Column) -> Column:
    """Offset in microseconds of a stated numeric or abbreviated zone; null if none is stated or it is beyond 18 h."""
    named = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    digits = F.regexp_replace(zone, ":", "")
    h, m = _number(F.substring(digits, 2, 2)), _number(F.substring(digits, 4, 2))
    numeric = F.when((h * 60 + m <= 18 * 60) & (m < 60), F.when(zone.startswith("-"), -(h * 60 + m)).otherwise(h * 60 + m))
    return F.when(zone.rlike(r"^[+-]\d"), numeric).otherwise(F.try_element_at(named, F.lower(zone)).cast("long")) * 60_000_000


def local_parts(text: Column, time_text: Column | None = None) -> Column:
    """``struct<instant_us, local_us, offset_us, zone>`` of a text, or of a date text with its time text.

    ``instant_us`` is set for epoch seconds (10 digits) or milliseconds (13 digits). ``local_us`` is
    the wall clock as microseconds since 1970-01-01; null if the text states no valid date and time.
    ``offset_us`` is the stated offset; ``zone`` the stated region name, if any.
    """
    def built(p: Column, instant: Column) -> Column:
        zone = F.nullif(p[7], F.lit(""))
        offset = _offset_us(zone)
        return F.struct(
            instant.alias("instant_us"),
            F.when(zone.isNull() | offset.isNotNull() | zone.contains("/"), _epoch_day(p[0], p[1], p[2]) * 86_400_000_000 + _of_day_us(p[3], p[4], p[5], p[6])).alias("local_us"),
            offset.alias("offset_us"),
            F.when(zone.contains("/"), zone).alias("zone"),
        )

    if time_text is None:
        epoch = lambda t: F.when(t.rlike(r"^\d{10}$"), t.try_cast("long") * 1_000_000).when(t.rlike(r"^\d{13}$"), t.try_cast("long") * 1_000)
        return _let(trimmed(text), lambda t: _let(_rewrite(t, _FAMILIES), lambda p: built(p, epoch(t))))
    parts = F.concat(_rewrite_of(trimmed(text), _DATES), _rewrite_of(trimmed(time_text), _TIMES))
    return _let(parts, lambda p: built(p, F.lit(None).cast("long")))


@functools.lru_cache(maxsize=None)
def offset_intervals(zone: str) -> list[tuple[int, int, int]]:
    """(local start, local end, offset) in seconds of every constant-offset span of a zone; the first one has no start."""
    tz = ZoneInfo(zone)
    at = lambda t: int(tz.utcoffset(t.astimezone(tz)).total_seconds())
    t, end = datetime(FIRST_YEAR - 1, 12, 1, tzinfo=UTC), datetime(LAST_YEAR + 1, 2, 1, tzinfo=UTC)
    start, off, out = -(2**42), at(t), []
    while t < end:
        # Rules change at will where clocks were set by law; outside, at most twice a year.
        nxt = t + timedelta(days=1 if 1880 <= t.year <= 2040 else 10)
        if at(nxt) != off:
            lo, hi = int(t.timestamp()), int(nxt.timestamp())
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if at(datetime.fromtimestamp(mid, UTC)) == off else (lo, mid)
            out.append((start + off, hi + off, off))
            start, off = hi, at(nxt)
        t = nxt
    return [*out, (start + off, int(end.timestamp()) + off, off)]


def interval_table(spark: SparkSession, zones: tuple[str, ...]) -> DataFrame:
    """Intervals exploded by month: a row for each zone and month with its ``spans array<struct<ls, le, off>>`` in microseconds."""
    rows: dict[tuple[str, int], list] = {}
    month = lambda s: (lambda d: d.year * 12 + d.month - 1)(datetime(1970, 1, 1) + timedelta(seconds=s))
    for zone in zones:
        for ls, le, off in offset_intervals(zone):
            for m in range(FIRST_YEAR * 12 if ls < -(2**40) else max(month(ls), FIRST_YEAR * 12), min(month(le - 1), LAST_YEAR * 12 + 11) + 1):
                rows.setdefault((zone, m), []).append((ls * 1_000_000, le * 1_000_000, off * 1_000_000))
    data = [(z, m, spans) for (z, m), spans in rows.items()]
    return spark.createDataFrame(data, "__tz_iv_zone string, __tz_iv_month int, __tz_spans array<struct<ls:bigint,le:bigint,off:bigint>>")


def stated_zones(df: DataFrame, *texts: Column) -> tuple[str, ...]:
    """The regions of the time zone database that texts end with: a pass over all of them, of at most as many rows as there are regions."""
    region = lambda c: F.regexp_extract(c, r"(?U)(?<![\w/])([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)\s*$", 1)
    every = None
    for c in texts:
        x = df.filter(c.contains("/")).select(region(c).alias("z"))
        every = x if every is None else every.union(x)
    return tuple(r["z"] for r in every.filter(F.col("z").isin(sorted(available_timezones()))).distinct().collect())


def to_instants(df: DataFrame, text: Column, default_zone: str, time_text: Column | None = None, zones: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``utc_us`` (bigint) and ``local_kind`` to every row of ``df``; no row is lost or repeated.

    ``local_kind``: ``stated`` (epoch or stated offset), ``unique``, ``ambiguous`` (the earlier instant
    is taken), ``skipped`` (moved forward by the gap's hour), or null where the text states no valid date
    and time; ``utc_us`` is then null. Nulls, empty texts and unknown zones give null. ``zones`` are the regions that
    texts may state; by default they are looked for in the texts. A column of ``df`` named like a result is replaced.
    """
    if zones is None:
        zones = stated_zones(df, text, *(() if time_text is None else (time_text,)))
    known = tuple(dict.fromkeys((*zones, default_zone)))
    spans = interval_table(df.sparkSession, known)
    p = "__tz_parts"
    x = df.withColumn(p, local_parts(text, time_text))
    stated = F.col(f"{p}.local_us")
    needs = stated.isNotNull() & F.col(f"{p}.offset_us").isNull()
    year = F.year(F.date_from_unix_date(F.floor(stated / 86_400_000_000).cast("int")))
    x = x.withColumn("__tz_back", F.greatest(F.ceil((year - LAST_YEAR) / CYCLE_YEARS), F.lit(0)) * CYCLE_US)
    x = x.withColumn("__tz_local", stated - F.col("__tz_back"))
    local = F.col("__tz_local")
    wall = F.date_from_unix_date(F.floor(local / 86_400_000_000).cast("int"))
    month = F.greatest(F.year(wall) * 12 + F.month(wall) - 1, F.lit(FIRST_YEAR * 12))
    x = x.withColumn("__tz_zone", F.when(needs, F.coalesce(F.col(f"{p}.zone"), F.lit(default_zone)))).withColumn("__tz_month", F.when(needs, month))
    x = x.join(F.broadcast(spans), (F.col("__tz_zone") == F.col("__tz_iv_zone")) & (F.col("__tz_month") == F.col("__tz_iv_month")), "left")
    hits = F.filter("__tz_spans", lambda s: (local >= s["ls"]) & (local < s["le"]))
    # In a gap the offset before it moves the wall clock forward by the gap's length.
    before = F.element_at(F.filter("__tz_spans", lambda s: local >= s["le"]), -1)["off"]
    n = F.size(hits)
    kind = F.when(F.col(f"{p}.instant_us").isNotNull() | (stated.isNotNull() & F.col(f"{p}.offset_us").isNotNull()), "stated").when(F.col("__tz_spans").isNotNull(), F.when(n == 1, "unique").when(n == 2, "ambiguous").otherwise("skipped"))
    utc = F.when(F.col(f"{p}.instant_us").isNotNull(), F.col(f"{p}.instant_us")).when(F.col(f"{p}.offset_us").isNotNull(), stated - F.col(f"{p}.offset_us"))
    utc = utc.when(n > 0, F.array_min(F.transform(hits, lambda s: local - s["off"])) + F.col("__tz_back")).otherwise(local - before + F.col("__tz_back"))
    return x.withColumns({"utc_us": utc, "local_kind": kind}).drop(p, "__tz_zone", "__tz_month", "__tz_iv_zone", "__tz_iv_month", "__tz_spans", "__tz_back", "__tz_local")
