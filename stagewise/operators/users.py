"""User sets as DataFrames and the one-shuffle stage aggregation behind the funnels.

A user set is a one-column DataFrame ``user_id``; duplicates are allowed and NULL is
never a user. Membership of a user in several sets is computed by one union and one
grouping on the user, with one bit per set. The grouping combines on the map side, so
a user who holds a large part of all rows costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.schemas import RENTER, USER

USER_ID = "user_id"

SEARCHED, CLICKED, RESERVED, PAID = 1, 2, 4, 8


def user_ids(df: DataFrame, column: str = USER) -> DataFrame:
    """The users of a table, one row per row of it."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias(USER_ID))


def renters(reservations: DataFrame) -> DataFrame:
    return user_ids(reservations, RENTER)


def in_all(sets: Sequence[DataFrame]) -> DataFrame:
    """Distinct users that occur in every one of ``sets``."""
    if len(sets) == 1:
        return sets[0].distinct()
    tagged = [s.select(USER_ID, F.lit(1 << i).alias("bits")) for i, s in enumerate(sets)]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy(USER_ID)
        .agg(F.bit_or("bits").alias("bits"))
        .where(F.col("bits") == (1 << len(sets)) - 1)
        .select(USER_ID)
    )


def in_first_only(users: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct users of the first set that are not in the second."""
    return (
        users.select(USER_ID, F.lit(1).alias("bits"))
        .unionByName(others.select(USER_ID, F.lit(2).alias("bits")))
        .groupBy(USER_ID)
        .agg(F.bit_or("bits").alias("bits"))
        .where("bits = 1")
        .select(USER_ID)
    )


def has(mask: Column | str, bits: int) -> Column:
    """Whether all of ``bits`` are set in ``mask``."""
    column = F.col(mask) if isinstance(mask, str) else mask
    return column.bitwiseAND(F.lit(bits)) == bits


def view_and_reservation_rows(views: DataFrame, reservations: DataFrame) -> DataFrame:
    """``(user_id, stages)`` for every view and reservation, not yet grouped.

    Payments are told apart only if the reservations have a payment column.
    """
    reserved = F.lit(RESERVED)
    if "successful_payment_collected_at" in reservations.columns:
        paid = F.col("successful_payment_collected_at").isNotNull()
        reserved = F.when(paid, F.lit(RESERVED | PAID)).otherwise(reserved)
    return (
        user_ids(views).select(USER_ID, F.lit(CLICKED).alias("stages"))
        .unionByName(
            reservations.where(F.col(RENTER).isNotNull())
            .select(F.col(RENTER).alias(USER_ID), reserved.alias("stages"))
        )
    )


def user_stages(searches: DataFrame, views: DataFrame, reservations: DataFrame) -> DataFrame:
    """One row per user with the bit mask of the stages the user ever reached."""
    rows = user_ids(searches).select(USER_ID, F.lit(SEARCHED).alias("stages"))
    return _reached(rows.unionByName(view_and_reservation_rows(views, reservations)))


def later_stages(views: DataFrame, reservations: DataFrame) -> DataFrame:
    """As :func:`user_stages`, for the stages after the search only."""
    return _reached(view_and_reservation_rows(views, reservations))


def _reached(rows: DataFrame) -> DataFrame:
    return rows.groupBy(USER_ID).agg(F.bit_or("stages").alias("stages"))


def funnel_users(searches: DataFrame, views: DataFrame, reservations: DataFrame) -> DataFrame:
    """Users who searched, clicked and reserved, in any order."""
    return in_all([user_ids(searches), user_ids(views), renters(reservations)])
