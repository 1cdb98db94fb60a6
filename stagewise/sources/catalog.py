"""Table listing, profiles and ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREVIEW_ROWS = 20


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types."""
    return list(df.dtypes)


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, as one job."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def run_sql(spark: SparkSession, query: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """Result of an ad-hoc query over the registered views, with named parameters."""
    return spark.sql(query, args=dict(args or {}))


def try_sql(
    spark: SparkSession, query: str, args: Mapping[str, Any] | None = None
) -> tuple[DataFrame | None, str | None]:
    """``(result, None)``, or ``(None, message)`` for a query that does not analyse."""
    try:
        return run_sql(spark, query, args), None
    except PySparkException as error:
        return None, str(error)


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows, for looking at."""
    return df.limit(n)
