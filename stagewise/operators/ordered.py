"""Time-ordered funnel: what a user did up to the moment of each reservation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions.times import minute_index
from stagewise.operators.users import USER_ID
from stagewise.schemas import RENTER, USER


def reservation_history(
    searches: DataFrame, views: DataFrame, reservations: DataFrame
) -> DataFrame:
    """Per reservation, the user's searches and clicks at or before ``created_at``.

    Only events of users who reserved at all are kept, and they are added up per user and
    instant before anything is ordered. Running sums have two exact parts: over a user's
    minutes, and over the instants of the minutes with a reservation. So a task holds at most
    one row per minute of a user, or per instant of one minute, however many events there are.
    """
    reserved = reservations.select(
        F.col(RENTER).alias(USER_ID), F.col("created_at").alias("at"), "reservation_id",
        "listing_id").where(F.col(USER_ID).isNotNull() & F.col("at").isNotNull())
    instants = _instants(searches, views, reserved)
    earlier = Window.partitionBy(USER_ID).orderBy("minute").rowsBetween(
        Window.unboundedPreceding, -1)
    minutes = (
        instants.groupBy(USER_ID, "minute")
        .agg(F.sum("s").alias("s"), F.sum("c").alias("c"),
             F.bool_or("is_reserved").alias("reserved"))
        .select(
            USER_ID, "minute", "reserved",
            F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s_before"),
            F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c_before"),
        )
        .where("reserved")
        .drop("reserved")
    )
    so_far = Window.partitionBy(USER_ID, "minute").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    counts = (
        instants.join(minutes, [USER_ID, "minute"])
        .select(
            USER_ID, "at", "is_reserved",
            (F.col("s_before") + F.sum("s").over(so_far)).alias("searches"),
            (F.col("c_before") + F.sum("c").over(so_far)).alias("clicks"),
        )
        .where("is_reserved")
    )
    return reserved.join(counts, [USER_ID, "at"]).select(
        "reservation_id", USER_ID, "searches", "clicks",
        F.col("at").alias("reservation_time"), "listing_id")


def ordered_funnel(searches: DataFrame, views: DataFrame, reservations: DataFrame) -> DataFrame:
    """Reservations that both a search and a click of the same user preceded."""
    history = reservation_history(searches, views, reservations)
    return history.where((F.col("searches") > 0) & (F.col("clicks") > 0))


def ordered_funnel_summary(ordered: DataFrame) -> DataFrame:
    """Reservations and users of an ordered funnel, and mean activity before reserving."""
    return ordered.agg(
        F.count("*").alias("reservations"),
        F.countDistinct(USER_ID).alias("users"),
        F.avg("searches").alias("avg_searches"),
        F.avg("clicks").alias("avg_clicks"),
    )


def _instants(searches: DataFrame, views: DataFrame, reserved: DataFrame) -> DataFrame:
    """Per instant of a user who reserved: searches, clicks, and whether they reserved then."""
    def events(df: DataFrame, s: int, c: int) -> DataFrame:
        return df.select(
            F.col(USER).alias(USER_ID), F.col("event_time").alias("at"),
            F.lit(s).alias("s"), F.lit(c).alias("c"))

    log = events(searches, 1, 0).unionByName(events(views, 0, 1)).where(F.col("at").isNotNull())
    log = log.join(reserved.select(USER_ID).distinct(), USER_ID, "left_semi")
    rows = log.withColumn("is_reserved", F.lit(False)).unionByName(reserved.select(
        USER_ID, "at", F.lit(0).alias("s"), F.lit(0).alias("c"), F.lit(True).alias("is_reserved")))
    return rows.groupBy(USER_ID, "at").agg(
        F.sum("s").alias("s"), F.sum("c").alias("c"),
        F.bool_or("is_reserved").alias("is_reserved")).withColumn("minute", minute_index(F.col("at")))
