"""Hand-made and random fact tables, and plain Python answers for them."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

START = datetime(2024, 3, 4)

SEARCH_SCHEMA = (
    "merged_amplitude_id string, search_id string, event_uuid string, event_time timestamp_ntz, "
    "month int, is_bot boolean, is_host boolean, is_usa_canada boolean, search_type string, "
    "search_sort string, search_term string, search_term_category string, search_dma string, "
    "first_attribution_source string, first_attribution_channel string, count_results int"
)
VIEW_SCHEMA = (
    "merged_amplitude_id string, search_id string, event_uuid string, event_time timestamp_ntz, "
    "month int, is_bot boolean, is_host boolean, is_listing_reserved boolean, listing_id string, "
    "search_position int, source_screen string, click_dma string, hex_1_resolution string, "
    "first_attribution_source string, first_attribution_channel string"
)
RESERVATION_SCHEMA = (
    "reservation_id string, renter_user_id string, listing_id string, created_at timestamp_ntz, "
    "approved_at timestamp_ntz, successful_payment_collected_at timestamp_ntz"
)


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def make(spark, schema: str, rows: list[dict]):
    return spark.createDataFrame([tuple(r.get(n) for n in names(schema)) for r in rows], schema)


def search(user, **values) -> dict:
    return {"merged_amplitude_id": user, "is_bot": False, "event_time": START} | values


view = search


def reservation(user, **values) -> dict:
    return {"renter_user_id": user, "created_at": START} | values


def random_rows(seed: int, n: int = 400):
    """Searches, views and reservations with NULLs and keys that hold a third of the rows."""
    rng = random.Random(seed)

    def pick(*values):
        return rng.choice(values)

    def hot(value, others):
        return value if rng.random() < 0.34 else rng.choice(others)

    def user():
        return hot("u0", [f"u{i}" for i in range(12)] + [None])

    def time():
        return START + timedelta(seconds=rng.randrange(0, 4 * 86400, 20))

    def common():
        t = time()
        return {
            "merged_amplitude_id": user(), "event_time": t, "month": pick(1, 2, 3, None),
            "search_id": hot("s0", [f"s{i}" for i in range(40)] + [None]),
            "event_uuid": str(rng.random()), "is_bot": pick(False, False, False, True, None),
            "is_host": pick(True, False, None),
            "first_attribution_source": pick("a", "b", None),
            "first_attribution_channel": pick("x", "y", None),
        }

    searches = [common() | {
        "is_usa_canada": pick(True, False, None), "search_type": hot("map", ["text", None]),
        "search_sort": pick("price", "distance", None), "search_term": pick("a", "long term", ""),
        "search_term_category": pick("type", "amenity", None),
        "search_dma": hot("d0", ["d1", "d2", None]),
        "count_results": pick(0, 1, 10, 11, 200, 1000, 1001, None),
    } for _ in range(n)]
    views = [common() | {
        "is_listing_reserved": pick(True, False, None),
        "listing_id": hot("7", [str(i) for i in range(0, 3000, 150)] + ["x", None]),
        "search_position": pick(0, 1, 3, 5, 6, 10, 15, 20, 21, None),
        "source_screen": pick("home", "search", None), "click_dma": hot("d0", ["d1", "d3", None]),
        "hex_1_resolution": pick("h1", "h2", None),
    } for _ in range(n)]
    reservations = [{
        "reservation_id": f"r{i}", "renter_user_id": user(), "created_at": (t := time()),
        "listing_id": hot("7", [str(i) for i in range(0, 4500, 150)] + [None]),
        "approved_at": pick(t, None), "successful_payment_collected_at": pick(t, None),
    } for i in range(n // 2)]
    return searches, views, reservations


def random_tables(spark, seed: int, n: int = 400):
    searches, views, reservations = random_rows(seed, n)
    return (make(spark, SEARCH_SCHEMA, searches), make(spark, VIEW_SCHEMA, views),
            make(spark, RESERVATION_SCHEMA, reservations))


def users(rows, column="merged_amplitude_id"):
    return {r[column] for r in rows if r[column] is not None}
