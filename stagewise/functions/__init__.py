"""Column-level building blocks; all stay inside Spark's code generation."""

from stagewise.functions.buckets import bucketize, label_order, range_label
from stagewise.functions.labels import (
    boolean_label,
    display_label,
    peak_label,
    reservation_status,
    search_session_id,
    source_channel,
    title_label,
)
from stagewise.functions.rates import pct, pct_change, pct_or_zero
from stagewise.functions.times import hour_of, hours_between, weekday_of

__all__ = [
    "boolean_label", "bucketize", "display_label", "hour_of", "hours_between", "label_order",
    "pct", "pct_change", "pct_or_zero", "peak_label", "range_label", "reservation_status",
    "search_session_id", "source_channel", "title_label", "weekday_of",
]
