"""The funnel's logical tables, read from the driver tables.

Each function takes the logical columns that a query needs and joins only the lookup
tables those columns come from, since Catalyst cannot drop an unused inner join. Lookup
joins carry no broadcast hint: Spark broadcasts those that are small when it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stagewise.schemas import RENTER, USER
from stagewise.sources.ingest import normalize_flags

# Labels that stand for the remainders of k.
SEARCH_TYPES = ("map", "text", "filter", "saved")
SEARCH_SORTS = ("relevance", "price_asc", "price_desc", "distance", None)
SOURCE_SCREENS = ("search", "home", "favourites")

# All events fall into one calendar month, so "month" is bound to the day of the month.
DAYS = range(1, 32)

FLAGS = ("is_bot", "is_host", "is_usa_canada")

_CUSTOMER = {"first_attribution_source", "is_host"}
_NATION = {"search_dma", "click_dma", "dma"}
_REGION = {"first_attribution_channel", "is_usa_canada", "hex_1_resolution"}
_PART = {"search_term", "search_term_category"}


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A driver table; its schema is looked up once, which is a job of its own."""
    path = f"{folder}/{table}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def search_events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    rows = _events(spark, folder, F.col("event_type") == "view")
    return _bind(spark, folder, rows, _search_columns(), columns)


def listing_views(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    rows = _events(spark, folder, (F.col("event_type") == "click") & (F.col("value") > 80))
    return _bind(spark, folder, rows, _view_columns(), columns)


def reservations(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    rows = _events(spark, folder, (F.col("event_type") == "purchase") & (F.col("value") > 100))
    return _bind(spark, folder, rows, _reservation_columns(), columns)


def raw_search_events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Searches as an extract spells them: flags are still text."""
    rows = _events(spark, folder, F.col("event_type") == "view")
    return _bind(spark, folder, rows, _search_columns(), columns, typed=False)


def identity_map(spark: SparkSession, folder: str) -> DataFrame:
    customer = read(spark, folder, "customer")
    return customer.select(F.col("c_custkey").alias(USER), F.col("c_custkey").alias("user_id"))


def account_map(spark: SparkSession, folder: str) -> DataFrame:
    """A map that is not the identity: every seventh searcher has no account, the others have
    two, and every eleventh shares the first one with the next searcher."""
    key = F.col("c_custkey")
    customer = read(spark, folder, "customer")
    known, shared = key % 7 != 3, key % 11 == 0
    accounts = F.array(
        F.when(known, F.struct(key.alias("searcher"), (key + FIRST).alias("account"))),
        F.when(known, F.struct(key.alias("searcher"), (key + SECOND).alias("account"))),
        F.when(shared, F.struct((key + 1).alias("searcher"), (key + FIRST).alias("account"))))
    return customer.select(F.inline(F.filter(accounts, lambda a: a.isNotNull()))).select(
        F.col("searcher").alias(USER), F.col("account").alias("user_id"))


FIRST, SECOND = 1_000_000_000, 2_000_000_000


def account_reservations(spark: SparkSession, folder: str) -> DataFrame:
    """Reservations under the account they were made with."""
    rows = reservations(spark, folder)
    return rows.withColumn(RENTER, F.col(RENTER) + F.when(
        F.col("listing_id") % 2 == 0, F.lit(FIRST)).otherwise(F.lit(SECOND)))


SEARCH_LINE = ("event_uuid", USER, "is_bot", "is_host", "count_results", "search_term",
               "event_time", "event_date", "month")
RESERVATION_LINE = ("reservation_id", RENTER, "created_at", "approved_at",
                    "successful_payment_collected_at")
# Spellings of flags and of cells that are none.
FLAG_SPELLINGS = ("True", "False", "0", "1", "t", "no", "2", "")
NO_TIME = "yesterday"


def search_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Searches as lines of a CSV extract, with gaps, quotes and cells that are malformed."""
    rows = _events(spark, folder, F.col("event_type") == "view")
    k, ts = F.col("k"), F.col("ts")
    count = (F.when(k % 6 == 0, "").when(k % 6 == 1, k.cast("string"))
             .when(k % 6 == 2, F.concat(k.cast("string"), F.lit(".0")))
             .when(k % 6 == 3, F.concat(k.cast("string"), F.lit(".5")))
             .when(k % 6 == 4, "many").otherwise((k * 3).cast("string")))
    term = F.when(k % 4 == 0, F.lit('"sea, view"')).when(k % 4 == 1, F.lit('"the ""old"" town"')) \
        .when(k % 4 == 2, "").otherwise(F.lit("plain"))
    time = F.when(k % 9 == 0, F.lit(NO_TIME)).when(
        k % 2 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    day = F.when(k % 10 == 7, F.lit("someday")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    cells = [F.col("event_id").cast("string"), F.col("user_id").cast("string"),
             _pick(FLAG_SPELLINGS, 8), _flag_text(k % 3 == 0), count, term, time, day,
             F.dayofmonth(ts).cast("string")]
    extra = F.when(k % 23 == 5, F.lit(",one too many")).otherwise("")
    return rows.select(F.concat(F.concat_ws(",", *cells), extra).alias("value"))


def reservation_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order reservations as lines of a CSV extract; times that are not known are empty."""
    def text(c):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))

    return order_reservations(spark, folder).select(F.concat_ws(
        ",", *[text(c) if c.endswith("_at") else F.col(c).cast("string")
               for c in RESERVATION_LINE]).alias("value"))


def item_views(spark: SparkSession, folder: str) -> DataFrame:
    """Listing views on the order lines, for listing analyses on more data."""
    return read(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("listing_id"),
        F.col("l_linenumber").alias("search_position"),
        F.col("l_shipdate").alias("event_time"),
        F.month("l_shipdate").alias("month"),
        F.col("l_returnflag").alias("source_screen"),
        (F.col("l_linestatus") == "F").alias("is_listing_reserved"),
    )


def item_reservations(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").where(
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    ).select(F.col("l_partkey").alias("listing_id"))


def order_reservations(spark: SparkSession, folder: str) -> DataFrame:
    """Reservations with payment lifecycle on the orders."""
    key, created, status = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    return read(spark, folder, "orders").select(
        key.alias("reservation_id"),
        F.col("o_custkey").alias(RENTER),
        created.alias("created_at"),
        F.when(status != "O", _after(created, key % 72)).alias("approved_at"),
        F.when(status == "F", _after(created, key % 200))
        .alias("successful_payment_collected_at"),
    )


def _events(spark: SparkSession, folder: str, where: Column) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, folder, "events").where(where).withColumn("k", k)


def _common_columns() -> dict[str, Callable[[], Column]]:
    return {
        "event_uuid": lambda: F.col("event_id"),
        USER: lambda: F.col("user_id"),
        "search_id": lambda: F.concat(
            F.col("user_id").cast("string"), F.lit("_"), F.to_date("ts").cast("string")),
        "event_time": lambda: F.col("ts"),
        "month": lambda: F.dayofmonth("ts"),
        "is_bot": lambda: _flag_text(F.col("k") % 10 == 0),
        "is_host": lambda: _flag_text(F.col("c_acctbal") > 5000),
        "first_attribution_source": lambda: F.col("c_mktsegment"),
        "first_attribution_channel": lambda: F.col("r_name"),
    }


def _search_columns() -> dict[str, Callable[[], Column]]:
    return _common_columns() | {
        "search_type": lambda: _pick(SEARCH_TYPES, 4),
        "search_sort": lambda: _pick(SEARCH_SORTS, 5),
        "count_results": lambda: F.when(F.col("k") % 13 != 0, (F.col("k") * 3).cast("int")),
        "search_term": lambda: F.col("p_name"),
        "search_term_category": lambda: F.col("p_type"),
        "search_dma": lambda: F.col("n_name"),
        "is_usa_canada": lambda: _flag_text(F.col("r_regionkey") == 1),
    }


def _view_columns() -> dict[str, Callable[[], Column]]:
    return _common_columns() | {
        "listing_id": lambda: F.col("k"),
        "search_position": lambda: (F.col("k") % 25 + 1).cast("int"),
        "source_screen": lambda: _pick(SOURCE_SCREENS, 3),
        "click_dma": lambda: F.col("n_name"),
        "hex_1_resolution": lambda: F.concat(F.lit("hex"), F.col("r_regionkey").cast("string")),
        "is_listing_reserved": lambda: F.col("k") % 2 == 0,
    }


def _reservation_columns() -> dict[str, Callable[[], Column]]:
    k, ts = F.col("k"), F.col("ts")
    return {
        "reservation_id": lambda: F.col("event_id"),
        RENTER: lambda: F.col("user_id"),
        "listing_id": lambda: k,
        "created_at": lambda: ts,
        "approved_at": lambda: F.when(k % 5 != 0, _after(ts, k)),
        "successful_payment_collected_at": lambda: F.when(k % 3 != 0, _after(ts, k * 2)),
        "dma": lambda: F.col("n_name"),
    }


def _bind(spark, folder, rows, available, columns, typed: bool = True) -> DataFrame:
    wanted = list(columns or available)
    names = set(wanted)
    if names & (_CUSTOMER | _NATION | _REGION):
        rows = rows.join(read(spark, folder, "customer"), F.col("user_id") == F.col("c_custkey"))
    if names & (_NATION | _REGION):
        rows = rows.join(
            read(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if names & _REGION:
        rows = rows.join(
            read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    if names & _PART:
        rows = rows.join(read(spark, folder, "part"), F.col("k") == F.col("p_partkey"))
    bound = rows.select(*[available[c]().alias(c) for c in wanted])
    return normalize_flags(bound, [f for f in FLAGS if f in names]) if typed else bound


def _pick(labels: tuple, count: int) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), (F.col("k") % count).cast("int"))


def _flag_text(condition: Column) -> Column:
    return F.when(condition, F.lit("True")).otherwise(F.lit("False"))


def _after(start: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, start)
