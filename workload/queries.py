"""One entry per analysis: ``name -> (spark, folder) -> DataFrame``.

Minimum supports are scaled down to the size of the test tables; they are ordinary
parameters of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.operators import dimensions as D
from stagewise.operators import (
    funnels,
    identity,
    insights,
    joined,
    journey,
    listings,
    ordered,
    payments,
    position,
    prepare,
    quality,
    segments,
    volume,
)
from stagewise.operators.users import funnel_users, in_first_only, user_ids
from stagewise.plans import reports
from stagewise.schemas import RENTER, RESERVATIONS, SEARCH_EVENTS, USER
from stagewise.sources import ingest
from stagewise.sources.catalog import run_sql, table_profile
from stagewise.sources.tables import read_table, register_views
from workload import bindings as B
from workload.bindings import DAYS

Query = Callable[[SparkSession, str], DataFrame]

MIN_SEGMENT_USERS = 5
MIN_TERM_USERS = 3
MIN_CHANNEL_USERS = 20
MIN_SOURCE_CHANNEL_USERS = 5
MIN_SOURCE_CHANNEL_CLICKERS = 4
MIN_ATTRIBUTION_USERS = 4
MIN_DMA_USERS = 5
MIN_SEGMENT_VIEWS = 20
MIN_TOP_LISTING_VIEWS = 10
HIGH_VOLUME_VIEWS = 35

SEARCH_DIMENSION_COLUMNS = (
    USER, "search_type", "search_term_category", "search_sort", "search_dma", "count_results",
    "search_term", "is_usa_canada", "is_bot", "is_host", "month", "event_time",
)
LINE_ITEM_DIMENSIONS = (
    D.LISTING_POSITION, D.SOURCE_SCREEN, D.month_dimension(), D.DAY_OF_WEEK,
    D.ALREADY_RESERVED, D.LISTING_ID_RANGE,
)

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def searches(spark, folder, *columns) -> DataFrame:
    """Searches without bots; only the user unless columns are named."""
    wanted = columns or (USER,)
    rows = B.search_events(spark, folder, *wanted, *([] if "is_bot" in wanted else ["is_bot"]))
    return prepare.without_bots(rows)


def views(spark, folder, *columns) -> DataFrame:
    """Listing views without bots; only the user unless columns are named."""
    wanted = columns or (USER,)
    rows = B.listing_views(spark, folder, *wanted, *([] if "is_bot" in wanted else ["is_bot"]))
    return prepare.without_bots(rows)


def renters(spark, folder) -> DataFrame:
    return B.reservations(spark, folder, RENTER)


def paid_reservations(spark, folder, *columns) -> DataFrame:
    return B.reservations(spark, folder, RENTER, "successful_payment_collected_at", *columns)


def all_searches(spark, folder, *columns) -> DataFrame:
    return B.search_events(spark, folder, *(columns or (USER,)))


def all_views(spark, folder, *columns) -> DataFrame:
    return B.listing_views(spark, folder, *(columns or (USER,)))


# Scans, bins and user sets


def _schema(of: T.StructType, names) -> T.StructType:
    return T.StructType([of[n] for n in names])


def _local_times(df: DataFrame) -> DataFrame:
    """Times as the wall clock of the session shows them."""
    return df.select(*[F.col(n).cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(n)
                       for n, t in df.dtypes])


def _search_text(spark, folder) -> DataFrame:
    return ingest.parse_lines(B.search_lines(spark, folder), B.SEARCH_LINE)


@query
def s01_typed_csv(spark, folder):
    return _local_times(ingest.normalize(
        _search_text(spark, folder), _schema(SEARCH_EVENTS, B.SEARCH_LINE)).drop(ingest.CORRUPT))


@query
def s01_rejects(spark, folder):
    return ingest.rejects(
        _search_text(spark, folder), _schema(SEARCH_EVENTS, B.SEARCH_LINE), "event_uuid")


@query
def s02_text_csv(spark, folder):
    return _search_text(spark, folder).withColumnRenamed(ingest.CORRUPT, "broken_line")


@query
def p01_normalised_reservations(spark, folder):
    text = ingest.parse_lines(B.reservation_lines(spark, folder), B.RESERVATION_LINE)
    return _local_times(ingest.normalize(
        text, _schema(RESERVATIONS, B.RESERVATION_LINE)).drop(ingest.CORRUPT))


@query
def s03_filtered_scan(spark, folder):
    return read_table(
        spark, f"{folder}/lineitem.parquet", where="l_returnflag = 'R' AND l_quantity > 45",
        columns=["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


@query
def s09_adhoc_sql(spark, folder):
    register_views({"search_events": B.search_events(
        spark, folder, USER, "search_type", "search_sort", "is_bot")})
    return run_sql(spark, """
        SELECT search_type, search_sort, count(*) AS searches,
          count(DISTINCT merged_amplitude_id) AS users
        FROM search_events WHERE NOT is_bot AND search_sort IS NOT NULL
        GROUP BY search_type, search_sort HAVING count(*) >= :least""", {"least": 10})


@query
def p14_search_bins(spark, folder):
    return prepare.search_bins(B.search_events(
        spark, folder, "event_uuid", "count_results", "search_term", "event_time", "is_host",
        "is_usa_canada"))


@query
def p18_view_bins(spark, folder):
    return prepare.view_bins(B.item_views(spark, folder).select(
        "listing_id", "search_position", "event_time"))


@query
def w02_search_frequency(spark, folder):
    return segments.search_frequency(all_searches(spark, folder))


@query
def u01_funnel_users(spark, folder):
    return funnel_users(
        all_searches(spark, folder), all_views(spark, folder), renters(spark, folder))


@query
def u02_never_clicked_users(spark, folder):
    return in_first_only(user_ids(all_searches(spark, folder)), user_ids(all_views(spark, folder)))


# Funnels


@query
def q01_funnel_counts(spark, folder):
    return funnels.funnel_counts(
        searches(spark, folder), views(spark, folder), paid_reservations(spark, folder))


@query
def q01_funnel_counts_mapped(spark, folder):
    return funnels.funnel_counts(
        searches(spark, folder), views(spark, folder), paid_reservations(spark, folder),
        identity_map=B.identity_map(spark, folder))


def _linked(spark, folder) -> DataFrame:
    """Reservations of accounts, resolved to searchers over a map that is not the identity."""
    return identity.resolve_renters(
        B.account_reservations(spark, folder), B.account_map(spark, folder))


@query
def j01_resolved_renters(spark, folder):
    return _linked(spark, folder).select("reservation_id", RENTER, "listing_id")


@query
def j01_resolved_or_unmatched(spark, folder):
    return identity.resolve_renters(
        B.account_reservations(spark, folder), B.account_map(spark, folder), "keep", "least"
    ).select("reservation_id", RENTER, "listing_id")


@query
def j01_unmatched_renters(spark, folder):
    return identity.unmatched_renters(
        B.account_reservations(spark, folder), B.account_map(spark, folder))


@query
def q01_funnel_counts_linked(spark, folder):
    return funnels.funnel_counts(
        searches(spark, folder), views(spark, folder), _linked(spark, folder))


@query
def q04_funnel_overlap_linked(spark, folder):
    return funnels.funnel_overlap(
        all_searches(spark, folder), all_views(spark, folder), _linked(spark, folder))


@query
def q05_ordered_funnel_linked(spark, folder):
    return ordered.ordered_funnel(
        all_searches(spark, folder, USER, "event_time"),
        all_views(spark, folder, USER, "event_time"), _linked(spark, folder))


@query
def q06_bot_impact_linked(spark, folder):
    return funnels.bot_impact(
        all_searches(spark, folder, USER, "is_bot"), all_views(spark, folder, USER, "is_bot"),
        _linked(spark, folder))


@query
def q07_funnel_by_channel_linked(spark, folder):
    return funnels.funnel_by_channel(
        all_searches(spark, folder, USER, "first_attribution_channel"),
        all_views(spark, folder), _linked(spark, folder))


@query
def q09_dropoff_linked(spark, folder):
    return funnels.dropoff(
        all_searches(spark, folder), all_views(spark, folder), _linked(spark, folder))


@query
def q16_monthly_trends_linked(spark, folder):
    return joined.monthly_trends(
        _search_facts(spark, folder, "month"), views(spark, folder, USER, "month"),
        _linked(spark, folder), F.dayofmonth("created_at"), DAYS)


@query
def q30_search_characteristics_linked(spark, folder):
    return segments.search_characteristics(
        all_searches(spark, folder, *SEARCH_DIMENSION_COLUMNS), all_views(spark, folder),
        _linked(spark, folder), months=DAYS, min_users=MIN_SEGMENT_USERS)


@query
def q33_weekday_conversion_linked(spark, folder):
    return segments.weekday_conversion(
        searches(spark, folder, USER, "event_time"), views(spark, folder),
        _linked(spark, folder))


@query
def q40_position_conversion_linked(spark, folder):
    return position.position_conversion(
        views(spark, folder, USER, "search_position"), _linked(spark, folder))


def _journey(spark, folder) -> DataFrame:
    return journey.user_journey(
        B.identity_map(spark, folder),
        prepare.prepare(searches(spark, folder, USER, "search_id", "event_uuid", "event_time"),
                        drop_bots=False, required=prepare.SEARCH_KEYS),
        prepare.prepare(views(spark, folder, USER, "listing_id", "event_uuid", "event_time"),
                        drop_bots=False, required=prepare.VIEW_KEYS),
        prepare.prepare(
            paid_reservations(spark, folder, "reservation_id", "listing_id", "created_at"),
            drop_bots=False, required=prepare.RESERVATION_KEYS),
    )


@query
def q02_user_journey(spark, folder):
    return _journey(spark, folder)


@query
def q03_funnel_from_journey(spark, folder):
    return journey.funnel_from_journey(_journey(spark, folder))


@query
def q04_funnel_overlap(spark, folder):
    return funnels.funnel_overlap(
        all_searches(spark, folder), all_views(spark, folder), renters(spark, folder))


@query
def q04_funnel_overlap_no_bots(spark, folder):
    return funnels.funnel_overlap(
        searches(spark, folder), views(spark, folder), renters(spark, folder))


def _ordered(spark, folder) -> DataFrame:
    return ordered.ordered_funnel(
        all_searches(spark, folder, USER, "event_time"),
        all_views(spark, folder, USER, "event_time"),
        B.reservations(spark, folder, "reservation_id", RENTER, "listing_id", "created_at"))


@query
def q05_ordered_funnel(spark, folder):
    return _ordered(spark, folder)


@query
def q05_ordered_funnel_summary(spark, folder):
    return ordered.ordered_funnel_summary(_ordered(spark, folder)).withColumns({
        "avg_searches": F.round("avg_searches", 6), "avg_clicks": F.round("avg_clicks", 6)})


@query
def q06_bot_impact(spark, folder):
    return funnels.bot_impact(
        all_searches(spark, folder, USER, "is_bot"), all_views(spark, folder, USER, "is_bot"),
        renters(spark, folder))


@query
def q07_funnel_by_channel(spark, folder):
    return funnels.funnel_by_channel(
        all_searches(spark, folder, USER, "first_attribution_channel"),
        all_views(spark, folder), renters(spark, folder))


@query
def q07_high_volume_channels(spark, folder):
    return funnels.with_support(
        q07_funnel_by_channel(spark, folder), "total_searchers", MIN_CHANNEL_USERS)


@query
def q07_top_channels(spark, folder):
    return funnels.top(q07_funnel_by_channel(spark, folder), 5,
                       "search_to_reserve_rate", "channel")


def _by_source_channel(spark, folder) -> DataFrame:
    return funnels.funnel_by_source_channel(
        all_searches(spark, folder, USER, "first_attribution_source",
                     "first_attribution_channel"),
        all_views(spark, folder), renters(spark, folder), ordered=False)


@query
def q08_funnel_by_source_channel(spark, folder):
    return funnels.with_support(
        _by_source_channel(spark, folder), "total_searchers", MIN_SOURCE_CHANNEL_USERS
    ).orderBy(F.desc("search_to_reserve_rate"), "source_channel")


@query
def q08_top_conversion(spark, folder):
    supported = funnels.with_support(
        _by_source_channel(spark, folder), "total_searchers", MIN_SOURCE_CHANNEL_USERS)
    return funnels.top(supported, 5, "search_to_reserve_rate", "source_channel")


@query
def q08_top_volume(spark, folder):
    return funnels.top(
        _by_source_channel(spark, folder), 5, "total_searchers", "source_channel")


@query
def q08_top_click_to_reserve(spark, folder):
    supported = funnels.with_support(
        _by_source_channel(spark, folder), "searched_and_clicked", MIN_SOURCE_CHANNEL_CLICKERS)
    return funnels.top(supported, 5, "click_to_reserve_rate", "source_channel")


@query
def q08_source_channel_volume(spark, folder):
    return funnels.source_channel_volume(
        all_searches(spark, folder, "first_attribution_source", "first_attribution_channel"))


@query
def q09_dropoff(spark, folder):
    return funnels.dropoff(
        all_searches(spark, folder), all_views(spark, folder), renters(spark, folder))


# Segment performance through joins


def _search_facts(spark, folder, *columns) -> DataFrame:
    return searches(spark, folder, USER, "search_id", "count_results", *columns)


@query
def q10_search_type_performance(spark, folder):
    return joined.search_type_performance(
        _search_facts(spark, folder, "search_type"), views(spark, folder, USER, "search_id"))


@query
def q11_attribution_performance(spark, folder):
    return joined.attribution_performance(
        _search_facts(spark, folder, "first_attribution_source", "first_attribution_channel"),
        views(spark, folder, USER, "search_id"), min_searchers=MIN_ATTRIBUTION_USERS)


@query
def q12_dma_performance(spark, folder):
    return joined.dma_performance(
        searches(spark, folder, USER, "search_dma"),
        views(spark, folder, USER, "click_dma", "listing_id"),
        paid_reservations(spark, folder, "listing_id"), min_searchers=MIN_DMA_USERS)


@query
def q13_category_performance(spark, folder):
    return joined.category_performance(
        _search_facts(spark, folder, "search_term_category"),
        views(spark, folder, USER, "search_id"))


@query
def q14_result_count_performance(spark, folder):
    return joined.result_count_performance(
        prepare.clean_searches(_search_facts(spark, folder, "event_time", "is_bot")),
        views(spark, folder, USER, "search_id"))


@query
def q15_hourly_patterns(spark, folder):
    return joined.hourly_patterns(
        prepare.clean_searches(_search_facts(spark, folder, "event_time", "is_bot")),
        prepare.clean_views(views(spark, folder, USER, "listing_id", "search_position",
                                  "event_time", "is_bot")))


@query
def q16_monthly_trends(spark, folder):
    return joined.monthly_trends(
        _search_facts(spark, folder, "month"), views(spark, folder, USER, "month"),
        paid_reservations(spark, folder, "created_at"),
        reservation_month=F.dayofmonth("created_at"), months=DAYS)


# Volumes and payments


@query
def q17_search_type_volume(spark, folder):
    return volume.search_type_volume(searches(spark, folder, USER, "search_type"))


@query
def q18_top_dmas(spark, folder):
    return volume.top_dmas(searches(spark, folder, USER, "search_dma"))


@query
def q19_top_attribution(spark, folder):
    return volume.top_attribution(
        searches(spark, folder, USER, "first_attribution_source", "first_attribution_channel"),
        min_users=MIN_ATTRIBUTION_USERS)


@query
def q20_monthly_volume(spark, folder):
    return volume.monthly_volume(searches(spark, folder, USER, "month"))


@query
def q21_category_volume(spark, folder):
    return volume.category_volume(searches(spark, folder, USER, "search_term_category"))


@query
def q22_payment_summary(spark, folder):
    return payments.payment_summary(B.order_reservations(spark, folder))


@query
def q22_payment_summary_cleaned(spark, folder):
    return payments.payment_summary(prepare.clean_reservations(
        B.reservations(spark, folder, RENTER, "listing_id", "created_at", "approved_at",
                       "successful_payment_collected_at")))


@query
def q23_monthly_payments(spark, folder):
    return payments.monthly_payments(B.order_reservations(spark, folder))


@query
def q24_cleaned_reservations(spark, folder):
    return prepare.clean_reservations(B.reservations(spark, folder))


@query
def q24_cleaned_orders(spark, folder):
    return prepare.clean_reservations(
        B.order_reservations(spark, folder), required=(RENTER, "created_at"))


@query
def q25_tagged_report(spark, folder):
    return insights.tagged_report({
        "FUNNEL_METRICS": (q03_funnel_from_journey(spark, folder), []),
        "SEARCH_TYPE_ANALYSIS": (q10_search_type_performance(spark, folder), ["search_type"]),
        "ATTRIBUTION_ANALYSIS": (
            q11_attribution_performance(spark, folder),
            ["first_attribution_source", "first_attribution_channel"]),
        "DMA_ANALYSIS": (q12_dma_performance(spark, folder), ["search_dma"]),
        "MONTHLY_TRENDS": (q16_monthly_trends(spark, folder), ["month"]),
        "PAYMENT_ANALYSIS": (q22_payment_summary(spark, folder), []),
    })


@query
def q26_cleaned_searches(spark, folder):
    return prepare.clean_searches(B.search_events(spark, folder))


@query
def q26_cleaned_views(spark, folder):
    return prepare.clean_views(B.listing_views(spark, folder))


@query
def q27_payment_status(spark, folder):
    return payments.payment_status(B.order_reservations(spark, folder))


@query
def q27_lifecycle_status(spark, folder):
    return payments.lifecycle_status(prepare.clean_reservations(
        B.order_reservations(spark, folder), required=(RENTER, "created_at")))


# Segment conversion


@query
def q30_search_characteristics(spark, folder):
    return segments.search_characteristics(
        all_searches(spark, folder, *SEARCH_DIMENSION_COLUMNS), all_views(spark, folder),
        renters(spark, folder), months=DAYS, min_users=MIN_SEGMENT_USERS)


@query
def q30_top_search_terms(spark, folder):
    return segments.search_terms(
        all_searches(spark, folder, USER, "search_term"), all_views(spark, folder),
        renters(spark, folder), min_users=MIN_TERM_USERS)


@query
def q31_non_converting_searches(spark, folder):
    return segments.non_converting_searches(
        all_searches(spark, folder, *SEARCH_DIMENSION_COLUMNS, "first_attribution_source",
                     "first_attribution_channel"),
        all_views(spark, folder), renters(spark, folder), months=DAYS,
        min_users=MIN_SEGMENT_USERS)


@query
def q31_worst_search_terms(spark, folder):
    return segments.search_terms(
        all_searches(spark, folder, USER, "search_term"), all_views(spark, folder),
        renters(spark, folder), metric="non_converting", min_users=MIN_TERM_USERS)


@query
def q32_never_clicked(spark, folder):
    return segments.never_clicked(
        all_searches(spark, folder, USER, "search_type", "search_term_category"),
        all_views(spark, folder), min_users=MIN_SEGMENT_USERS)


@query
def q33_weekday_conversion(spark, folder):
    return segments.weekday_conversion(
        searches(spark, folder, USER, "event_time"), views(spark, folder),
        renters(spark, folder))


@query
def q33_weekday_weekend(spark, folder):
    return _rounded(segments.weekday_weekend(q33_weekday_conversion(spark, folder)))


@query
def q34_monthly_conversion(spark, folder):
    return segments.monthly_conversion(
        searches(spark, folder, USER, "month"), views(spark, folder), renters(spark, folder),
        months=DAYS).withColumn("avg_rate", F.round("avg_rate", 6))


@query
def q35_host_conversion(spark, folder):
    return segments.host_conversion(
        searches(spark, folder, USER, "is_host"), views(spark, folder), renters(spark, folder))


@query
def q35_host_gap(spark, folder):
    return _rounded(segments.host_gap(q35_host_conversion(spark, folder)))


@query
def q36_sort_preference(spark, folder):
    return segments.single_dimension(
        searches(spark, folder, USER, "search_sort"), views(spark, folder),
        renters(spark, folder), D.SEARCH_SORT)


@query
def q37_term_category(spark, folder):
    return segments.single_dimension(
        searches(spark, folder, USER, "search_term_category"), views(spark, folder),
        renters(spark, folder), D.TERM_CATEGORY)


@query
def q38_geography(spark, folder):
    return segments.geography_conversion(
        searches(spark, folder, USER, "is_usa_canada"), views(spark, folder),
        renters(spark, folder))


@query
def q39_peak_hours(spark, folder):
    return segments.peak_conversion(
        searches(spark, folder, USER, "event_time"), views(spark, folder),
        renters(spark, folder))


# Position and sort


@query
def q40_position_conversion(spark, folder):
    return position.position_conversion(
        views(spark, folder, USER, "search_position"), renters(spark, folder))


@query
def q40_position_funnel(spark, folder):
    return position.position_funnel(
        searches(spark, folder), views(spark, folder, USER, "search_position"),
        renters(spark, folder))


@query
def q40_position_insights(spark, folder):
    return _rounded(position.position_insights(
        q40_position_conversion(spark, folder), "conversion_rate", "total_clickers"))


def _approved(spark, folder) -> DataFrame:
    return prepare.approved_only(B.reservations(spark, folder, RENTER, "approved_at"))


@query
def q41_bucket_conversion(spark, folder):
    return position.bucket_conversion(
        views(spark, folder, USER, "search_position"), _approved(spark, folder))


@query
def q41_bucket_insights(spark, folder):
    return _rounded(position.bucket_insights(q41_bucket_conversion(spark, folder)))


@query
def q42_estimated_buckets(spark, folder):
    return position.estimated_bucket_conversion(
        views(spark, folder, USER, "search_position"), _approved(spark, folder))


@query
def q43_sort_conversion(spark, folder):
    return _rounded(position.sort_conversion(
        searches(spark, folder, USER, "search_sort", "count_results"),
        all_views(spark, folder)))


@query
def q44_click_distribution(spark, folder):
    return position.click_distribution(views(spark, folder, "search_position"))


@query
def q44_click_insights(spark, folder):
    return _rounded(position.position_insights(
        q44_click_distribution(spark, folder), "click_percentage", "total_clicks"))


# Listings


def _stats(spark, folder) -> DataFrame:
    return listings.listing_stats(
        B.item_views(spark, folder), B.item_reservations(spark, folder))


@query
def q50_listing_stats(spark, folder):
    return _stats(spark, folder)


@query
def q51_listing_segments(spark, folder):
    return listings.listing_segment_conversion(
        B.item_views(spark, folder), B.item_reservations(spark, folder),
        LINE_ITEM_DIMENSIONS, min_views=MIN_SEGMENT_VIEWS)


@query
def q51_listing_segments_events(spark, folder):
    return listings.listing_segment_conversion(
        B.listing_views(spark, folder), B.reservations(spark, folder, "listing_id"),
        D.listing_dimensions(DAYS), min_views=MIN_SEGMENT_VIEWS)


@query
def q52_high_volume_listings(spark, folder):
    return listings.high_volume_listings(_stats(spark, folder), min_views=HIGH_VOLUME_VIEWS)


@query
def q53_listing_summary(spark, folder):
    return listings.listing_summary(
        B.item_views(spark, folder), B.item_reservations(spark, folder))


@query
def q54_top_listings(spark, folder):
    return listings.top_listings(_stats(spark, folder), min_views=MIN_TOP_LISTING_VIEWS)


# Insights and data checks


def _extremes(spark, folder) -> DataFrame:
    by_search = segments.segment_conversion(
        searches(spark, folder, USER, "search_sort", "search_term_category", "is_usa_canada",
                 "is_host", "event_time"),
        [D.SEARCH_SORT, D.TERM_CATEGORY, D.GEOGRAPHY, D.USER_TYPE, D.PEAK],
        segments.full_funnel(views(spark, folder), renters(spark, folder)),
        min_users=0, ordered=False)
    rates = by_search.select(
        F.col("dimension").alias("analysis"), F.col("segment").alias("characteristic"),
        "conversion_rate")
    by_position = insights.rated(
        q40_position_funnel(spark, folder), "search_position", "characteristic")
    return insights.extremes(rates.unionByName(by_position))


@query
def q55_extremes(spark, folder):
    return _rounded(_extremes(spark, folder))


def _tables(spark, folder) -> reports.Tables:
    return reports.Tables(
        B.search_events(spark, folder), B.listing_views(spark, folder),
        B.reservations(spark, folder))


@query
def q55_all_extremes(spark, folder):
    return _rounded(reports.insight_report(_tables(spark, folder), DAYS)["extremes"])


#: Each chart's key columns and its metrics.
CHARTS = {
    "funnel": ([], "total_searchers total_viewers total_reservers total_payers overall_rate"),
    "search_type_volume": (["search_type"], "events unique_users"),
    "top_dmas": (["search_dma"], "unique_searchers"),
    "top_attribution": (
        ["first_attribution_source", "first_attribution_channel"], "unique_users"),
    "monthly_volume": (["month"], "events unique_users"),
    "category_volume": (["search_term_category"], "events unique_users"),
    "weekday": (["day_of_week"], "total_searchers funnel_users conversion_rate"),
    "monthly": (["month"], "total_searchers funnel_users conversion_rate"),
    "hosts": (["user_type"], "total_searchers funnel_users conversion_rate market_share"),
    "sort": (["search_sort"], "total_searchers funnel_users conversion_rate"),
    "category": (["search_term_category"], "total_searchers funnel_users conversion_rate"),
    "geography": (["characteristic"], "total_users converting_users conversion_rate"),
    "peak_hours": (["characteristic"], "total_users converting_users conversion_rate"),
    "position": (["search_position"], "total_clickers funnel_users conversion_rate"),
    "position_buckets": (
        ["position_bucket"], "total_clickers converting_users conversion_rate"),
    "position_buckets_estimated": (
        ["position_bucket"], "total_clickers estimated_converting_users"),
    "clicks": (["search_position"], "total_clicks cumulative_percentage"),
    "sort_activity": (["search_sort"], "total_users converting_users overall_rate"),
}


@query
def s12_chart_tables(spark, folder):
    bundle = reports.chart_tables(_tables(spark, folder), DAYS, MIN_ATTRIBUTION_USERS)
    parts = {
        name: (bundle[name].select(*keys, *metrics.split()), keys)
        for name, (keys, metrics) in CHARTS.items()}
    return _rounded(insights.tagged_report(parts))


@query
def q56_top_characteristics(spark, folder):
    return insights.top_characteristics(_extremes(spark, folder))


@query
def q57_opportunities(spark, folder):
    return _rounded(insights.opportunities(
        q01_funnel_counts(spark, folder), q10_search_type_performance(spark, folder),
        q22_payment_summary(spark, folder)))


@query
def q60_table_profile(spark, folder):
    return table_profile({
        "search_events": B.search_events(spark, folder, USER),
        "listing_views": B.listing_views(spark, folder, USER),
        "reservations": B.reservations(spark, folder, RENTER),
        "amplitude_user_ids": B.identity_map(spark, folder),
    })


@query
def q61_bot_distribution(spark, folder):
    return quality.value_counts(B.raw_search_events(spark, folder, "is_bot"), "is_bot")


@query
def q61_distinct_flags(spark, folder):
    return quality.distinct_values(B.raw_search_events(spark, folder, "is_bot"), "is_bot")


@query
def q62_sort_counts(spark, folder):
    return quality.value_counts(
        B.search_events(spark, folder, "search_sort"), "search_sort", drop_null=True)


@query
def q62_filter_counts(spark, folder):
    sort_known, human = F.col("search_sort").isNotNull(), ~F.col("is_bot")
    return quality.filter_counts(
        B.search_events(spark, folder, "search_sort", "is_bot"),
        {"all": F.lit(True), "not_bot": human, "sort_known": sort_known,
         "sort_known_not_bot": sort_known & human})


@query
def q63_linkage_check(spark, folder):
    return funnels.linkage_check(
        searches(spark, folder), views(spark, folder), renters(spark, folder))


def _rounded(df: DataFrame) -> DataFrame:
    """Means of rates to 6 places: their last bits depend on the order of summing."""
    return df.select(*[
        F.round(name, 6).alias(name) if dtype == "double" else F.col(name)
        for name, dtype in df.dtypes])
