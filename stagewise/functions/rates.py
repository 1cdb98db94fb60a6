"""Percentages with the two zero-denominator rules in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``; NULL when ``whole`` is 0, rounded."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def pct_or_zero(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; 0 when ``whole`` is 0, not rounded."""
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))


def pct_change(new: Column, old: Column) -> Column:
    """Relative change from ``old`` to ``new`` in percent; NULL when ``old`` is 0."""
    return F.try_divide((new - old).cast("double"), old) * F.lit(100.0)
