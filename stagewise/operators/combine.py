"""Putting result frames of the same keys side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(keys: Sequence[str], frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of one row per ``keys`` as one frame; a NULL key is a key like any other.

    A union and one grouping, where joins would need one shuffle each and could not match
    NULL keys by plain equality.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in rows.columns if c not in keys])
