"""Time parts. They accept TIMESTAMP and TIMESTAMP_NTZ columns alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The week in display order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
WEEKEND = ("Saturday", "Sunday")

_MICROS_PER_HOUR = 3_600_000_000.0


def hours_between(start: Column, end: Column) -> Column:
    """Hours from ``start`` to ``end``, NULL if either is."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(_MICROS_PER_HOUR)


def weekday_of(ts: Column) -> Column:
    """Name of the day, NULL for NULL."""
    # Not element_at: in ANSI mode it takes the result for non-NULL even if the index is NULL.
    return F.get(F.array(*[F.lit(day) for day in WEEKDAYS]), F.weekday(ts))


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def minute_index(ts: Column) -> Column:
    """Minutes since 1970-01-01 on the wall clock."""
    hours = F.unix_date(F.to_date(ts)) * F.lit(24) + F.hour(ts)
    return hours * F.lit(60) + F.minute(ts)
