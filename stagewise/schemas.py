"""Explicit schemas of the four source tables.

Every id is a string so that both sides of a join share one type. Flags are
booleans whatever their spelling in the extract (``True``, ``False``, ``0``, ``1``);
:mod:`stagewise.sources.ingest` does the typing.
"""

from __future__ import annotations

from pyspark.sql import types as T

USER = "merged_amplitude_id"
RENTER = "renter_user_id"

_STRING, _DOUBLE, _INT = T.StringType(), T.DoubleType(), T.IntegerType()
_BOOL, _TS, _DATE = T.BooleanType(), T.TimestampType(), T.DateType()


def _fields(names: str, dtype: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, dtype, True) for name in names.split()]


_HEX = " ".join(f"hex_{i}_resolution" for i in range(1, 10))

SEARCH_EVENTS = T.StructType(
    _fields("event_uuid event_type merged_amplitude_id ip_address search_id search_type "
            "search_term prior_search_id", _STRING)
    + _fields("latitude longitude", _DOUBLE)
    + _fields("is_bot is_host is_neighbor_office is_lehi_centerpoint_latlng is_usa_canada", _BOOL)
    + _fields("count_results", _INT)
    + _fields(f"top20_listing_id search_sort search_term_category {_HEX} search_dma "
              "first_attribution_source first_attribution_channel", _STRING)
    + _fields("event_time", _TS)
    + _fields("event_date", _DATE)
    + _fields("month", _INT)
)

LISTING_VIEWS = T.StructType(
    _fields("event_uuid event_type merged_amplitude_id ip_address listing_id", _STRING)
    + _fields("latitude longitude", _DOUBLE)
    + _fields("is_bot is_host is_listing_reserved", _BOOL)
    + _fields("source_screen", _STRING)
    + _fields("search_position", _INT)
    + _fields(f"search_id {_HEX} click_dma first_attribution_source first_attribution_channel",
              _STRING)
    + _fields("event_time", _TS)
    + _fields("event_date", _DATE)
    + _fields("month", _INT)
)

RESERVATIONS = T.StructType(
    _fields("reservation_id renter_user_id host_user_id listing_id", _STRING)
    + _fields("created_at approved_at successful_payment_collected_at", _TS)
    + _fields("hex_08_id dma", _STRING)
)

IDENTITY_MAP = T.StructType(_fields("merged_amplitude_id user_id", _STRING))

TABLES = {
    "search_events": SEARCH_EVENTS,
    "listing_views": LISTING_VIEWS,
    "reservations": RESERVATIONS,
    "amplitude_user_ids": IDENTITY_MAP,
}
