"""Event and user volumes of single tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.operators.dimensions import Dimension
from stagewise.schemas import USER


TOP_DMAS, TOP_ATTRIBUTION, MIN_ATTRIBUTION_USERS = 15, 10, 50


def volume(searches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events and distinct users per value of ``keys``."""
    return searches.groupBy(*keys).agg(
        F.count("*").alias("events"), F.countDistinct(USER).alias("unique_users"))


def search_type_volume(searches: DataFrame) -> DataFrame:
    return volume(searches, ["search_type"]).orderBy(F.desc("events"), "search_type")


def category_volume(searches: DataFrame) -> DataFrame:
    named = searches.where(F.col("search_term_category").isNotNull())
    return volume(named, ["search_term_category"]).orderBy(
        F.desc("events"), "search_term_category")


def monthly_volume(searches: DataFrame) -> DataFrame:
    return volume(searches, ["month"]).orderBy("month")


def top_dmas(searches: DataFrame, n: int = TOP_DMAS) -> DataFrame:
    """The ``n`` markets with the most searchers."""
    return (
        searches.where(F.col("search_dma").isNotNull())
        .groupBy("search_dma")
        .agg(F.countDistinct(USER).alias("unique_searchers"))
        .orderBy(F.desc("unique_searchers"), "search_dma")
        .limit(n)
    )


def top_attribution(
    searches: DataFrame, min_users: int = MIN_ATTRIBUTION_USERS, n: int = TOP_ATTRIBUTION
) -> DataFrame:
    """The ``n`` largest source and channel pairs with at least ``min_users`` users."""
    keys = ["first_attribution_source", "first_attribution_channel"]
    return (
        searches.where(F.col(keys[0]).isNotNull())
        .groupBy(*keys)
        .agg(F.countDistinct(USER).alias("unique_users"))
        .where(F.col("unique_users") >= min_users)
        .orderBy(F.desc("unique_users"), *keys)
        .limit(n)
    )


def volumes(searches: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """(dimension, segment, events, unique_users) of several open dimensions from one scan.

    One grouping by value and user; a NULL value is a segment like any other.
    """
    values = [c for i, d in enumerate(dimensions) for c in (F.lit(i).cast("tinyint"), d.column())]
    names = F.array(*[F.lit(d.name) for d in dimensions])
    return (
        searches.select(F.col(USER), F.stack(F.lit(len(dimensions)), *values)
                        .alias("number", "segment"))
        .groupBy("number", "segment", USER).agg(F.count("*").alias("events"))
        .groupBy("number", "segment")
        .agg(F.sum("events").alias("events"), F.count(USER).alias("unique_users"))
        .select(F.get(names, F.col("number")).alias("dimension"), "segment", "events",
                "unique_users")
    )
