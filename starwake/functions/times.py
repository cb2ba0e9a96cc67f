"""Time columns. Every report takes an explicit ``as_of`` so that it can be repeated."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = str | datetime


def moment(as_of: Moment) -> Column:
    """A UTC timestamp literal; constant folding turns it into a pushed-down filter value."""
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(UTC).replace(tzinfo=None)
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp")


def day(as_of: Moment | date) -> Column:
    if isinstance(as_of, date) and not isinstance(as_of, datetime):
        return F.lit(as_of.isoformat()).cast("date")
    return F.to_date(moment(as_of))


def days_before(as_of: Moment, days: int) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def hours_before(as_of: Moment, hours: int) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")


def in_window(ts: Column, as_of: Moment, days: int) -> Column:
    """``[as_of - days, as_of)``."""
    return (ts >= days_before(as_of, days)) & (ts < moment(as_of))


def twice(days: int) -> int:
    """How far back a report that compares two windows has to read."""
    return max(2 * days, 2)


def in_previous_window(ts: Column, as_of: Moment, days: int) -> Column:
    """``[as_of - 2 days, as_of - days)``."""
    return (ts >= days_before(as_of, twice(days))) & (ts < days_before(as_of, days))


def in_date_window(event_date: Column, as_of: Moment, days: int) -> Column:
    """Whole days: the days + 1 dates up to and including that of ``as_of``."""
    return (event_date >= F.date_sub(day(as_of), days)) & (event_date <= day(as_of))


def week_start(as_of: Moment | Column) -> Column:
    """Monday 00:00 at UTC+7 of the week of a moment, as a UTC instant."""
    local = F.from_utc_timestamp(as_of if isinstance(as_of, Column) else moment(as_of), "+07:00")
    return F.to_utc_timestamp(F.date_trunc("week", local), "+07:00")


def parse_iso(text: Column) -> Column:
    """ISO text with or without fraction or zone. Unreadable text gives NULL, not an error."""
    return F.try_to_timestamp(text)


def search_range(days: Column) -> Column:
    """Coarse age bucket used when asking for news."""
    return F.when(days <= 7, "day").when(days <= 31, "month").otherwise("year")
