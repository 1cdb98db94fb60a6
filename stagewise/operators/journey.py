"""Per-user journeys over an identity map, and the funnel read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import pct
from stagewise.schemas import RENTER, USER


def user_journey(
    identity_map: DataFrame, searches: DataFrame, views: DataFrame, reservations: DataFrame
) -> DataFrame:
    """Activity of every identity: counts, first and last times, and stage flags.

    Each fact is reduced to one row per user before it meets the identity map, so the
    three one-to-many joins never multiply each other.
    """
    identities = identity_map.select(USER, "user_id").distinct()
    searched = searches.where(F.col(USER).isNotNull()).groupBy(USER).agg(
        F.countDistinct("search_id").alias("total_searches"),
        F.countDistinct("event_uuid").alias("total_search_events"),
        F.min("event_time").alias("first_search_time"),
        F.max("event_time").alias("last_search_time"),
    )
    viewed = views.where(F.col(USER).isNotNull()).groupBy(USER).agg(
        F.countDistinct("listing_id").alias("unique_listings_viewed"),
        F.countDistinct("event_uuid").alias("total_view_events"),
        F.min("event_time").alias("first_view_time"),
        F.max("event_time").alias("last_view_time"),
    )
    paid = F.col("successful_payment_collected_at").isNotNull()
    reserved = reservations.where(F.col(RENTER).isNotNull()).groupBy(
        F.col(RENTER).alias("user_id")
    ).agg(
        F.countDistinct("reservation_id").alias("total_reservations"),
        F.countDistinct(F.when(paid, F.col("reservation_id"))).alias("successful_payments"),
    )
    counts = ["total_searches", "total_search_events", "unique_listings_viewed",
              "total_view_events", "total_reservations", "successful_payments"]
    return (
        identities.join(searched, USER, "left")
        .join(viewed, USER, "left")
        .join(reserved, "user_id", "left")
        .fillna(0, counts)
        .withColumns({
            "has_viewed_listing": _flag(F.col("unique_listings_viewed") > 0),
            "has_made_reservation": _flag(F.col("total_reservations") > 0),
            "has_completed_payment": _flag(F.col("successful_payments") > 0),
        })
    )


def funnel_from_journey(journey: DataFrame) -> DataFrame:
    """Distinct users per stage of a journey table and the four stage rates."""
    def users(condition: Column) -> Column:
        return F.bool_or(condition)

    per_user = journey.where(F.col(USER).isNotNull()).groupBy(USER).agg(
        users(F.col("total_searches") > 0).alias("searched"),
        users(F.col("has_viewed_listing") == 1).alias("viewed"),
        users(F.col("has_made_reservation") == 1).alias("reserved"),
        users(F.col("has_completed_payment") == 1).alias("paid"),
    )
    counts = per_user.agg(
        F.count("*").alias("total_users"),
        F.count_if("searched").alias("users_who_searched"),
        F.count_if("viewed").alias("users_who_viewed"),
        F.count_if("reserved").alias("users_who_reserved"),
        F.count_if("paid").alias("users_who_paid"),
    )
    searched, viewed = F.col("users_who_searched"), F.col("users_who_viewed")
    reserved, paid = F.col("users_who_reserved"), F.col("users_who_paid")
    return counts.withColumns({
        "search_to_view_rate": pct(viewed, searched),
        "view_to_reserve_rate": pct(reserved, viewed),
        "reserve_to_pay_rate": pct(paid, reserved),
        "overall_conversion_rate": pct(paid, searched),
    })


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))
