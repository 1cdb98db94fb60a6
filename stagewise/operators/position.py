"""Clicks and measured conversion by result position, and conversion by sort order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions import pct_or_zero, range_label
from stagewise.functions.buckets import POSITION_BUCKETS
from stagewise.operators import dimensions as D
from stagewise.operators.segments import spine_conversion
from stagewise.operators.users import USER_ID, in_all, renters, user_ids
from stagewise.schemas import USER

LAST_POSITION = 20
TOP_POSITIONS = 5


def position_conversion(views: DataFrame, reservations: DataFrame,
                        last: int = LAST_POSITION) -> DataFrame:
    """Clickers per position and how many of them ever reserved, positions 1 to ``last``."""
    by_position = spine_conversion(
        views, D.position_dimension(last), [renters(reservations)], users="total_clickers")
    return numbered(by_position).orderBy("search_position")


def position_funnel(searches: DataFrame, views: DataFrame, reservations: DataFrame,
                    last: int = 10) -> DataFrame:
    """As :func:`position_conversion`, for clickers who searched as well as reserved."""
    by_position = spine_conversion(
        views, D.position_dimension(last), [user_ids(searches), renters(reservations)],
        "total_users", "converting_users")
    return (
        numbered(by_position)
        .select(F.concat(F.lit("Position "), F.col("search_position").cast("string"))
                .alias("characteristic"),
                "total_users", "converting_users", "conversion_rate")
    )


def position_insights(by_position: DataFrame, rate: str, total: str) -> DataFrame:
    """Top positions against the rest, and the decline from first to last position.

    Positions without data are left out. ``decline`` is first minus last rate,
    ``decline_per_step`` spreads it over the positions in between.
    """
    position, value = F.col("search_position"), F.col(rate)
    top = position <= TOP_POSITIONS
    return (
        by_position.where(F.col(total) > 0)
        .agg(
            F.avg(F.when(top, value)).alias("top_avg"),
            F.avg(F.when(~top, value)).alias("rest_avg"),
            F.avg(value).alias("avg_rate"),
            F.min_by(value, position).alias("first_rate"),
            F.max_by(value, position).alias("last_rate"),
            (F.max(position) - F.min(position)).alias("steps"),
        )
        .withColumns({
            "top_minus_rest": F.col("top_avg") - F.col("rest_avg"),
            "decline": F.col("first_rate") - F.col("last_rate"),
        })
        .withColumn("decline_per_step", F.try_divide(F.col("decline"), F.col("steps")))
        .drop("steps")
    )


def bucket_conversion(views: DataFrame, approved: DataFrame) -> DataFrame:
    """Clickers per position bucket and how many of them had a reservation approved."""
    return spine_conversion(
        views, D.POSITION_BUCKET, [renters(approved)], "total_clickers", "converting_users"
    ).orderBy("position_bucket_order")


def bucket_insights(by_bucket: DataFrame) -> DataFrame:
    """Mean rate of the buckets within the first ten positions against the others."""
    first_ten = F.col("position_bucket").isin("Positions 1-5", "Positions 6-10")
    rate = F.col("conversion_rate")
    return by_bucket.agg(
        F.avg(F.when(first_ten, rate)).alias("top_10_avg"),
        F.avg(F.when(~first_ten, rate)).alias("lower_avg"),
        F.avg(rate).alias("avg_rate"),
    ).withColumn("top_minus_lower", F.col("top_10_avg") - F.col("lower_avg"))


def estimated_bucket_conversion(views: DataFrame, approved: DataFrame) -> DataFrame:
    """Converted users spread over the buckets by their share of clicks.

    An estimate, not a measurement (see :func:`bucket_conversion`): it ranks buckets by
    repeat clicking. The number of converted users is computed from the data.
    """
    converted = in_all([user_ids(views), renters(approved)]).agg(F.count("*").alias("n"))
    buckets = range(len(POSITION_BUCKETS))
    bucket = range_label(F.col("search_position"), POSITION_BUCKETS)
    per_user = views.select(F.col(USER).alias(USER_ID), bucket.alias("bucket")).groupBy(
        USER_ID).agg(F.count("*").alias("clicks"),
                     *[F.count_if(F.col("bucket") == label).alias(f"c{i}")
                       for i, (_, _, label) in enumerate(POSITION_BUCKETS)])
    counts, rows = [F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks")], []
    for i in buckets:
        clicks = F.col(f"c{i}")
        counts += [F.coalesce(F.sum(clicks), F.lit(0)).alias(f"c{i}"),
                   F.count_if(F.col(USER_ID).isNotNull() & (clicks > 0)).alias(f"u{i}")]
        rows += [F.lit(POSITION_BUCKETS[i][2]), F.col(f"u{i}"), F.col(f"c{i}")]
    share = F.when(F.col("clicks") > 0, F.col("bucket_clicks") / F.col("clicks")).otherwise(0.0)
    estimated, clickers = F.col("estimated_converting_users"), F.col("total_clickers")
    return (
        per_user.agg(*counts)
        .select("clicks", F.stack(F.lit(len(POSITION_BUCKETS)), *rows)
                .alias("position_bucket", "total_clickers", "bucket_clicks"))
        .withColumn("click_proportion", share)
        .withColumn("estimated_converting_users",
                    F.floor(converted.scalar() * F.col("click_proportion")))
        .select("position_bucket", "total_clickers", "click_proportion",
                "estimated_converting_users",
                pct_or_zero(estimated, clickers).alias("estimated_conversion_rate"))
    )


def click_distribution(views: DataFrame, last: int = LAST_POSITION) -> DataFrame:
    """Clicks per position 1 to ``last``, share of all clicks and running share.

    The denominator is every click, at whatever position. One single-row aggregate is
    unfolded into the positions.
    """
    positions = range(1, last + 1)
    counts = [F.count_if(F.col("search_position") == p).alias(f"p{p}") for p in positions]
    rows, so_far = [], F.lit(0)
    for p in positions:
        so_far = so_far + F.col(f"p{p}")
        rows += [F.lit(p), F.col(f"p{p}"), so_far]
    return (
        views.agg(F.count("*").alias("all_clicks"), *counts)
        .select("all_clicks", F.stack(F.lit(last), *rows)
                .alias("search_position", "total_clicks", "running_clicks"))
        .select(
            "search_position", "total_clicks",
            pct_or_zero(F.col("total_clicks"), F.col("all_clicks")).alias("click_percentage"),
            pct_or_zero(F.col("running_clicks"), F.col("all_clicks"))
            .alias("cumulative_percentage"))
        .orderBy("search_position")
    )


def sort_conversion(searches: DataFrame, views: DataFrame) -> DataFrame:
    """Users per sort order and how many of them have any view, with their activity.

    Views count whether or not a bot made them. ``overall_rate`` is over the users of
    any sort order.

    Searches and views are one list, grouped by user and sort order (none for a view). What
    is left of a user are as many rows as there are sort orders, over which a window looks
    for a view; the rate over all users is added up from each user's first row.
    """
    of_user = Window.partitionBy(USER)
    listed = searches.where(F.col("search_sort").isNotNull()).select(
        USER, "search_sort", F.lit(1).alias("searches"),
        F.col("count_results").cast("bigint").alias("results"),
        F.col("count_results").isNotNull().cast("bigint").alias("counted"), F.lit(0).alias("viewed"))
    seen = views.where(F.col(USER).isNotNull()).select(
        F.col(USER), F.lit(None).cast("string").alias("search_sort"), F.lit(0).alias("searches"),
        F.lit(None).cast("bigint").alias("results"), F.lit(0).cast("bigint").alias("counted"),
        F.lit(1).alias("viewed"))
    profile = (
        listed.unionByName(seen).groupBy(USER, "search_sort").agg(
            *[F.sum(c).alias(c) for c in ("searches", "results", "counted")],
            F.max("viewed").alias("viewed"))
        .withColumns({
            "viewed": F.max("viewed").over(of_user) == 1,
            "first": F.row_number().over(of_user.orderBy(F.col("search_sort").asc_nulls_last())) == 1,
        })
        .where("search_sort is not null")
    )
    somebody = F.col(USER).isNotNull()
    users, converting = F.col("total_users"), F.col("converting_users")
    # One row per sort order: a window without partitions is safe here.
    everyone = Window.partitionBy()
    return (
        profile.groupBy("search_sort")
        .agg(
            F.count(USER).alias("total_users"),
            F.count_if(somebody & F.col("viewed")).alias("converting_users"),
            F.sum("searches").alias("total_searches"),
            F.try_divide(F.sum("results").cast("double"), F.sum("counted"))
            .alias("avg_results"),
            F.count_if(somebody & F.col("first")).alias("people"),
            F.count_if(somebody & F.col("first") & F.col("viewed")).alias("viewers"),
        )
        .withColumns({
            "conversion_rate": pct_or_zero(converting, users),
            "avg_searches_per_user": _ratio(F.col("total_searches"), users),
            "overall_rate": pct_or_zero(F.sum("viewers").over(everyone), F.sum("people").over(everyone)),
        })
        .drop("people", "viewers")
        .orderBy(F.desc("conversion_rate"), "search_sort")
    )


def numbered(by_position: DataFrame) -> DataFrame:
    """Positions as numbers instead of labels."""
    return by_position.drop("search_position_order").withColumn(
        "search_position", F.col("search_position").cast("int"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
