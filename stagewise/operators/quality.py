"""Data checks: raw flag values, value counts, and rows left by each filter."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, drop_null: bool = False) -> DataFrame:
    """Rows per value of ``column``, most frequent first."""
    df = df.where(F.col(column).isNotNull()) if drop_null else df
    return df.groupBy(column).agg(F.count("*").alias("row_count")).orderBy(
        F.desc("row_count"), column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def filter_counts(df: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """Rows that pass each named filter, in one scan."""
    names = list(filters)
    return (
        df.agg(*[F.count_if(filters[n]).alias(n) for n in names])
        .select(F.stack(F.lit(len(names)), *[c for n in names for c in (F.lit(n), F.col(n))])
                .alias("filter_name", "row_count"))
    )
