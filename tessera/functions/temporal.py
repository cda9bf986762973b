"""Valid time: current, as-of and overlap predicates."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_as_of(value: str | None) -> datetime | None:
    """None or blank means now; a time without offset is UTC; anything unreadable raises ValueError."""
    if value is None or not value.strip():
        return None
    at = datetime.fromisoformat(value.strip())
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def valid_at(as_of: datetime | str | None = None, alias: str = "") -> Column:
    """Rows valid at a time, half-open with nulls as open ends; without a time, the rows still open."""
    at = parse_as_of(as_of) if isinstance(as_of, str) or as_of is None else as_of
    start, end = F.col(f"{alias}valid_from"), F.col(f"{alias}valid_to")
    if at is None:
        return end.isNull()
    t = F.lit(at)
    return (start.isNull() | (start <= t)) & (end.isNull() | (end > t))


def starts_near(other: Column, start: Column, end: Column, days: int) -> Column:
    """Whether ``other`` is unknown or within ``days`` of the span [start, end or start]; an unknown start allows all."""
    span = F.expr(f"make_interval(0, 0, 0, {int(days)})")
    return other.isNull() | start.isNull() | other.between(start - span, F.coalesce(end, start) + span)
