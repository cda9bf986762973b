"""Small parsers and keys the sources share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or(c: Column, default: str) -> Column:
    """``c`` unless it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def stable_id(*parts: Column) -> Column:
    """20 hex digits of the SHA-256 of the parts joined by a bar; null is written as ``None``."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 20)


def candidate_key(kind: Column, ids: Column) -> Column:
    """32 hex digits of a type and a set of ids, whatever their order."""
    return F.substring(F.sha2(F.concat_ws("|", kind, F.array_join(F.array_sort(ids), "|")), 256), 1, 32)


def decimal_comma(c: Column) -> Column:
    """``26,3`` as 26.3; below detection (``<7``), ``--`` and the unreadable as null."""
    return F.when(~F.trim(c).startswith("<"), F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double"))


def date_and_clock(date: Column, clock: Column) -> Column:
    """``dd.MM.yyyy`` with ``HH:mm``; 24:00 is the next day's midnight."""
    day = F.try_to_timestamp(date, F.lit("dd.MM.yyyy"))
    h, m = F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", 1).try_cast("int"), F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", 2).try_cast("int")
    return F.when((h <= 24) & (m < 60), day + F.make_dt_interval(F.lit(0), h, m, F.lit(0).cast("decimal(18,6)")))


# Fixed value: ISO 8601 as far as it is a date, or a date with a clock.
ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)\s*(Z|[+-]\d{2}:?\d{2})?)?$"


def iso_time(c: Column) -> Column:
    """ISO date or time; without offset it is UTC, whatever the session's zone; ``+0200`` is an offset too; all else is null."""
    t = F.trim(c)
    clock, zone = F.regexp_extract(t, ISO, 2), F.regexp_extract(t, ISO, 3)
    offset = F.when(zone == "", "Z").otherwise(F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2"))
    whole = F.concat(F.regexp_extract(t, ISO, 1), F.lit("T"), F.rpad(clock, F.greatest(F.length(clock), F.lit(5)), F.lit("00:00")), F.when(F.length(clock) <= 5, ":00").otherwise(""), offset)
    return F.when(t.rlike(ISO), whole).try_cast("timestamp")


def iso_time_or_date(c: Column) -> Column:
    """``iso_time``, or the midnight of a date that something unreadable follows."""
    return F.coalesce(iso_time(c), iso_time(F.substring(F.trim(c), 1, 10)))


def rfc_time(c: Column) -> Column:
    """RFC 822 time with a numeric offset, else ISO."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), iso_time(c))


def epoch_time(c: Column) -> Column:
    """Epoch seconds; 0 is unknown."""
    return F.timestamp_seconds(F.nullif(c.cast("long"), F.lit(0).cast("long")))


def share_pct(part: Column, whole: Column) -> Column:
    """Percentage to two places; null if either is null or zero."""
    return F.round(100.0 * F.nullif(part, F.lit(0)) / F.nullif(whole, F.lit(0)), 2)


def first_tag(xml: Column, tag: str) -> Column:
    """Text of the first element of a name, across lines; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))


def tag_by_parent(tags: Column, parent: str) -> Column:
    """The value of the first tag that has ``parent`` among its parents."""
    return F.get(F.filter(tags, lambda t: F.array_contains(t["parentValues"], parent)), F.lit(0))["value"]


def url_parameter(url: Column, name: str) -> Column:
    return F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)), F.lit(""))
