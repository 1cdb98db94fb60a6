"""Binning: half-open interval bins and closed integer ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bin edges and labels of the standard analyses. Bins are (low, high].
RESULT_COUNT_EDGES = (0, 10, 50, 100, 200, 1000)
RESULT_COUNT_LABELS = ("1-10", "11-50", "51-100", "101-200", "200+")
TERM_LENGTH_EDGES = (0, 5, 10, 15, 30, 100)
TERM_LENGTH_LABELS = ("1-5 chars", "6-10 chars", "11-15 chars", "16-30 chars", "30+ chars")
HOUR_EDGES = (0, 6, 12, 18, 24)
HOUR_LABELS = ("Night (0-6)", "Morning (6-12)", "Afternoon (12-18)", "Evening (18-24)")
FREQUENCY_EDGES = (0, 1, 3, 10, 100)
FREQUENCY_LABELS = ("1 search", "2-3 searches", "4-10 searches", "10+ searches")
POSITION_EDGES = (0, 5, 10, 15, 20, 100)
POSITION_LABELS = ("1-5", "6-10", "11-15", "16-20", "20+")
LISTING_ID_EDGES = (0, 100, 500, 1000, 2000, 10000)
LISTING_ID_LABELS = ("1-100", "101-500", "501-1000", "1001-2000", "2000+")

# Closed ranges (low, high, label) and the label of everything else.
RESULT_COUNT_RANGES = (
    (0, 0, "No Results"),
    (1, 10, "1-10 Results"),
    (11, 50, "11-50 Results"),
    (51, 100, "51-100 Results"),
    (101, 200, "101-200 Results"),
)
RESULT_COUNT_ELSE = "200+ Results"
POSITION_RANGES = ((1, 5, "Top 5"), (6, 10, "6-10"), (11, 20, "11-20"))
POSITION_ELSE = "20+"
POSITION_BUCKETS = (
    (1, 5, "Positions 1-5"),
    (6, 10, "Positions 6-10"),
    (11, 15, "Positions 11-15"),
    (16, 20, "Positions 16-20"),
)


def bucketize(
    value: Column,
    edges: Sequence[float],
    labels: Sequence[str],
    right: bool = True,
    else_label: str | None = None,
) -> Column:
    """Label of the bin that holds ``value``.

    Bins are ``(low, high]``, or ``[low, high)`` with ``right=False``. Values outside
    all bins and NULLs get ``else_label``, which is NULL by default.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("bucketize needs one more edge than labels")
    if list(edges) != sorted(set(edges)):
        raise ValueError("bucketize edges must increase")

    def below(edge: float) -> Column:
        return value <= edge if right else value < edge

    picked = F.when(below(edges[0]), F.lit(else_label))
    for edge, label in zip(edges[1:], labels):
        picked = picked.when(below(edge), F.lit(label))
    return picked.otherwise(F.lit(else_label))


def bucket_index(value: Column, edges: Sequence[float]) -> Column:
    """0-based number of the ``(low, high]`` bin that holds ``value``, else NULL."""
    return bucketize(value, edges, range(len(edges) - 1))


def range_label(
    value: Column,
    ranges: Sequence[tuple[int, int, str]],
    else_label: str | None = None,
) -> Column:
    """Label of the closed range ``low <= value <= high``; ``else_label`` also takes NULLs."""
    picked = None
    for low, high, label in ranges:
        picked = (F if picked is None else picked).when(value.between(low, high), F.lit(label))
    return picked.otherwise(F.lit(else_label))


def range_index(value: Column, ranges: Sequence[tuple[int, int, str]]) -> Column:
    """0-based number of the closed range that holds ``value``, else NULL."""
    return range_label(value, [(low, high, i) for i, (low, high, _) in enumerate(ranges)])


def label_order(label: Column, labels: Sequence[str]) -> Column:
    """1-based place of ``label`` in ``labels``, NULL for any other label."""
    picked = None
    for place, name in enumerate(labels, 1):
        picked = (F if picked is None else picked).when(label == name, F.lit(place))
    return picked
