"""Cleaning and the derived columns of the three fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.functions import (
    hour_of,
    hours_between,
    range_label,
    reservation_status,
    search_session_id,
)
from stagewise.functions.buckets import (
    POSITION_ELSE,
    POSITION_RANGES,
    RESULT_COUNT_ELSE,
    RESULT_COUNT_RANGES,
)
from stagewise.operators import dimensions as D
from stagewise.schemas import RENTER, USER

SEARCH_KEYS = (USER, "search_id", "event_time")
VIEW_KEYS = (USER, "listing_id", "event_time")
RESERVATION_KEYS = (RENTER, "listing_id", "created_at")


def without_bots(events: DataFrame) -> DataFrame:
    """Events flagged as not from a bot; a NULL flag is dropped, as SQL would."""
    return events.where(~F.col("is_bot"))


def prepare(df: DataFrame, drop_bots: bool = True, required: Sequence[str] = ()) -> DataFrame:
    """Rows fit for analysis: bots out on request, required columns not NULL."""
    df = without_bots(df) if drop_bots else df
    return df.dropna(subset=list(required)) if required else df


def approved_only(reservations: DataFrame) -> DataFrame:
    return reservations.where(F.col("approved_at").isNotNull())


def clean_searches(searches: DataFrame) -> DataFrame:
    """Human searches with complete keys and result category, hour and session key."""
    return prepare(searches, required=SEARCH_KEYS).withColumns({
        "result_count_category": range_label(
            F.col("count_results"), RESULT_COUNT_RANGES, RESULT_COUNT_ELSE),
        "search_hour": hour_of(F.col("event_time")),
        "search_session_id": search_session_id(F.col(USER), F.col("event_time")),
    })


def clean_views(views: DataFrame) -> DataFrame:
    """Human listing views with complete keys, position category and hour."""
    return prepare(views, required=VIEW_KEYS).withColumns({
        "position_category": range_label(
            F.col("search_position"), POSITION_RANGES, POSITION_ELSE),
        "view_hour": hour_of(F.col("event_time")),
    })


def clean_reservations(
    reservations: DataFrame, required: Sequence[str] = RESERVATION_KEYS
) -> DataFrame:
    """Reservations with complete keys, lifecycle status, waiting times and month."""
    created = F.col("created_at")
    approved, paid = F.col("approved_at"), F.col("successful_payment_collected_at")
    return prepare(reservations, drop_bots=False, required=required).withColumns({
        "reservation_status": reservation_status(approved, paid),
        "hours_to_approval": hours_between(created, approved),
        "hours_to_payment": hours_between(created, paid),
        "reservation_month": F.month(created),
    })


def search_bins(searches: DataFrame) -> DataFrame:
    """Searches with the label of every closed search dimension."""
    dims = [D.RESULT_COUNT, D.TERM_LENGTH, D.DAY_OF_WEEK, D.HOUR_BIN, D.PEAK, D.USER_TYPE,
            D.GEOGRAPHY]
    return searches.withColumns({f"{d.name}_label": d.column() for d in dims})


def view_bins(views: DataFrame) -> DataFrame:
    """Listing views with position bin, position bucket and listing id range."""
    dims = [D.LISTING_POSITION, D.POSITION_BUCKET, D.LISTING_ID_RANGE]
    return views.withColumns({f"{d.name}_label": d.column() for d in dims})
