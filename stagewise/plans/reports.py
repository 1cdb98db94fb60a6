"""Named bundles of results: a dict of DataFrames that can be released.

Results are lazy, except that a frame that several results are cut from is computed once
(:class:`stagewise.plans.sharing.Store`). Write a bundle with
:func:`stagewise.sources.tables.write_bundle`, then call its ``release``.

With an identity map, every analysis that compares users works on reservations whose renter
is resolved to the searcher; counts of reservations alone work on them as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.functions import title_label
from stagewise.operators import dimensions as D
from stagewise.operators import (
    funnels,
    insights,
    joined,
    journey,
    listings,
    ordered,
    payments,
    position,
    prepare,
    segments,
    volume,
)
from stagewise.operators.identity import resolve_renters
from stagewise.operators.users import user_ids
from stagewise.plans.sharing import Bundle, Store
from stagewise.schemas import RENTER


@dataclass(frozen=True)
class Tables:
    """The typed source tables."""

    searches: DataFrame
    views: DataFrame
    reservations: DataFrame
    identity_map: DataFrame | None = None

    @classmethod
    def of(cls, tables: Mapping[str, DataFrame]) -> Tables:
        """From tables under their source names."""
        return cls(tables["search_events"], tables["listing_views"], tables["reservations"],
                   tables.get("amplitude_user_ids"))

    def without_bots(self) -> Tables:
        return replace(self, searches=prepare.without_bots(self.searches),
                       views=prepare.without_bots(self.views))

    def cleaned(self) -> Tables:
        """Bots and incomplete keys out, derived columns added."""
        return replace(
            self, searches=prepare.clean_searches(self.searches),
            views=prepare.clean_views(self.views),
            reservations=prepare.clean_reservations(self.reservations))

    def linked(self, unmatched: str = "drop", shared: str = "all") -> Tables:
        """With renters resolved to searchers, once; without a map, as they are.

        The options are those of :func:`stagewise.operators.identity.resolve_renters`.
        """
        if self.identity_map is None:
            return self
        resolved = resolve_renters(self.reservations, self.identity_map, unmatched, shared)
        return replace(self, reservations=resolved, identity_map=None)

    def facts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.searches, self.views, self.reservations


def funnel_report(tables: Tables) -> Bundle:
    """Overall funnels of all events, of human events, and in time order."""
    linked = tables.linked()
    facts, humans = linked.facts(), linked.without_bots()
    store = Store()
    in_order = store.share(ordered.ordered_funnel(*facts))
    report = {
        "funnel_counts": funnels.funnel_counts(*humans.facts()),
        "funnel_overlap": funnels.funnel_overlap(*facts),
        "ordered_funnel": in_order,
        "ordered_funnel_summary": ordered.ordered_funnel_summary(in_order),
        "bot_impact": funnels.bot_impact(*facts),
        "dropoff": funnels.dropoff(*facts),
        "by_channel": funnels.funnel_by_channel(*facts),
        "by_source_channel": funnels.funnel_by_source_channel(*facts),
    }
    if tables.identity_map is not None:
        per_user = store.share(journey.user_journey(
            tables.identity_map, *tables.cleaned().facts()))
        report["user_journey"] = per_user
        report["funnel_metrics"] = journey.funnel_from_journey(per_user)
    return Bundle(report, store)


def performance_report(tables: Tables) -> Bundle:
    """Funnel, segments through joins, months and payments of human events."""
    searches, views, reservations = tables.linked().without_bots().facts()
    known = reservations.where(F.col(RENTER).isNotNull())
    return Bundle({
        "funnel_metrics": funnels.funnel_counts(searches, views, known),
        "search_type": joined.search_type_performance(searches, views),
        "attribution": joined.attribution_performance(searches, views),
        "geographic": joined.dma_performance(searches, views, known),
        "monthly": joined.monthly_trends(searches, views, known),
        "payment": payments.payment_summary(tables.reservations),
        "categories": joined.category_performance(searches, views),
    })


def cleaned_report(tables: Tables) -> Bundle:
    """The analyses that need complete keys and derived columns."""
    cleaned = tables.cleaned()
    searches, views, linked = tables.linked().cleaned().facts()
    reservations = cleaned.reservations
    store = Store()
    report = {
        "result_counts": joined.result_count_performance(searches, views),
        "hourly": joined.hourly_patterns(searches, views),
        "monthly_payments": payments.monthly_payments(reservations),
        "lifecycle": payments.lifecycle_status(reservations),
    }
    tagged = {
        "SEARCH_TYPE_ANALYSIS": (
            joined.search_type_performance(searches, views), ["search_type"]),
        "ATTRIBUTION_ANALYSIS": (
            joined.attribution_performance(searches, views),
            ["first_attribution_source", "first_attribution_channel"]),
        "DMA_ANALYSIS": (joined.dma_performance(searches, views, linked), ["search_dma"]),
        "MONTHLY_TRENDS": (joined.monthly_trends(searches, views, linked), ["month"]),
        "PAYMENT_ANALYSIS": (payments.payment_summary(reservations), []),
    }
    if tables.identity_map is not None:
        per_user = journey.user_journey(tables.identity_map, *cleaned.facts())
        tagged["FUNNEL_METRICS"] = (journey.funnel_from_journey(per_user), [])
    report["tagged"] = insights.tagged_report(tagged)
    return Bundle(report, store)


def characteristics_report(tables: Tables, min_users: int = segments.MIN_USERS) -> Bundle:
    """Conversion by each search characteristic, and the best search terms."""
    facts = searches, views, reservations = tables.linked().facts()
    picked = D.search_dimensions()
    store = Store()
    long = store.share(segments.segment_conversion(
        searches, picked, segments.full_funnel(views, reservations),
        min_users=min_users, frequency=True, ordered=False))
    names = [d.name for d in picked] + [segments.SEARCH_FREQUENCY.name]
    return Bundle(_by_dimension(long, names, "conversion_rate") | {
        "top_terms": segments.search_terms(*facts)}, store)


def non_converting_report(tables: Tables, min_users: int = segments.MIN_USERS) -> Bundle:
    """Non-conversion by each search characteristic, drop-off and users who never clicked."""
    facts = searches, views, reservations = tables.linked().facts()
    picked = [*D.search_dimensions(), *D.attribution_dimensions()]
    store = Store()
    long = store.share(segments.segment_conversion(
        searches, picked, segments.full_funnel(views, reservations),
        metric="non_converting", min_users=min_users, frequency=True, ordered=False))
    names = [d.name for d in picked]
    never = store.share(segments.never_clicked(
        searches, views, min_users=min_users, ordered=False))
    clicked = _by_dimension(never, ["search_type", "search_term_category"], "never_clicked_rate")
    return Bundle(_by_dimension(
        long, [*names, segments.SEARCH_FREQUENCY.name], "non_conversion_rate") | {
        "worst_terms": segments.search_terms(*facts, metric="non_converting"),
        "dropoff": funnels.dropoff(*facts),
        "never_clicked_by_type": clicked["search_type"],
        "never_clicked_by_term": clicked["search_term_category"],
    }, store)


def listing_report(tables: Tables, min_views: int = listings.MIN_VIEWS) -> Bundle:
    """Reservations per view by each characteristic, listing statistics and top listings."""
    views, reservations = tables.views, tables.reservations
    store = Store()
    long = store.share(listings.listing_segment_conversion(
        views, reservations, min_views=min_views, ordered=False))
    stats = store.share(listings.listing_stats(views, reservations))
    return Bundle(_by_dimension(
        long, [d.name for d in D.listing_dimensions()], "conversion_rate") | {
        "listing_stats": stats,
        "high_volume": listings.high_volume_listings(stats),
        "top_listings": listings.top_listings(stats),
        "summary": listings.listing_summary(views, reservations),
    }, store)


def searcher_population(tables: Tables, months: range = D.MONTHS) -> DataFrame:
    """All that is told of searchers by characteristic, from one pass over the three facts.

    Counts: viewers, reservers, payers and funnel_users (viewed and reserved).
    """
    searches, views, reservations = tables.facts()
    paid = F.col("successful_payment_collected_at").isNotNull()
    reserved = reservations.where(F.col(RENTER).isNotNull()).select(
        F.col(RENTER).alias("user_id"), F.lit(True).alias("reserved"), paid.alias("paid"))
    return segments.population(
        searches,
        [D.ALL, D.DAY_OF_WEEK, D.month_dimension(months), D.USER_TYPE, D.GEOGRAPHY, D.PEAK,
         D.SEARCH_SORT, D.TERM_CATEGORY],
        {"viewed": user_ids(views), ("reserved", "paid"): reserved},
        {"viewers": ["viewed"], "reservers": ["reserved"], "payers": ["paid"],
         "funnel_users": ["viewed", "reserved"]})


def clicker_population(tables: Tables, last: int = position.LAST_POSITION) -> DataFrame:
    """All that is told of clickers by position, from one pass over the three facts.

    Counts: reservers, approved (with an approved reservation) and funnel_users (searched and
    reserved).
    """
    searches, views, reservations = tables.facts()
    reserved = reservations.where(F.col(RENTER).isNotNull()).select(
        F.col(RENTER).alias("user_id"), F.lit(True).alias("reserved"),
        F.col("approved_at").isNotNull().alias("approved"))
    return segments.population(
        views, [D.position_dimension(last), D.POSITION_BUCKET],
        {"searched": user_ids(searches), ("reserved", "approved"): reserved},
        {"reservers": ["reserved"], "approved_users": ["approved"],
         "funnel_users": ["searched", "reserved"]})


def chart_tables(
    tables: Tables, months: range = D.MONTHS,
    min_attribution_users: int = volume.MIN_ATTRIBUTION_USERS,
) -> Bundle:
    """The table behind each chart, on human events.

    Searchers, clickers and volumes are three shared frames that most tables are cut from.
    """
    humans = tables.linked().without_bots()
    searches, views, reservations = humans.facts()
    approved = prepare.approved_only(reservations)
    store = Store()
    people = store.share(searcher_population(humans, months))
    clickers = store.share(clicker_population(humans))
    pair = F.struct("first_attribution_source", "first_attribution_channel")
    counted = store.share(volume.volumes(searches, [
        D.SEARCH_TYPE, D.SEARCH_DMA, D.TERM_CATEGORY, D.open_dimension("month"),
        D.Dimension("attribution", lambda: F.to_json(
            pair, {"ignoreNullFields": "false"}))]))

    def volume_of(name: str, column: str) -> DataFrame:
        return counted.where(F.col("dimension") == name).select(
            F.col("segment").alias(column), "events", "unique_users")

    named = F.from_json("pair", "first_attribution_source string, first_attribution_channel string")
    funnel = people.where(F.col("dimension") == D.ALL.name).agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{name}") for c, name in (
            ("users", "searchers"), ("viewers", "viewers"), ("reservers", "reservers"),
            ("payers", "payers"))])
    by_position = segments.spined(
        clickers, D.position_dimension(position.LAST_POSITION), "reservers", "total_clickers")
    return Bundle({
        "funnel": funnels.with_losses(funnel),
        "search_type_volume": volume_of("search_type", "search_type").orderBy(
            F.desc("events"), "search_type"),
        "top_dmas": volume_of("dma", "search_dma").where("search_dma is not null").select(
            "search_dma", F.col("unique_users").alias("unique_searchers")).orderBy(
            F.desc("unique_searchers"), "search_dma").limit(volume.TOP_DMAS),
        "top_attribution": volume_of("attribution", "pair").select(
            named.alias("named"), "unique_users").select("named.*", "unique_users").where(
            F.col("first_attribution_source").isNotNull()
            & (F.col("unique_users") >= min_attribution_users)).orderBy(
            F.desc("unique_users"), "first_attribution_source", "first_attribution_channel").limit(
            volume.TOP_ATTRIBUTION),
        "monthly_volume": volume_of("month", "month").withColumn(
            "month", F.col("month").cast("int")).orderBy("month"),
        "category_volume": volume_of("search_term_category", "search_term_category").where(
            "search_term_category is not null").orderBy(F.desc("events"), "search_term_category"),
        "payment_status": payments.payment_status(tables.reservations),
        "weekday": segments.spined(people, D.DAY_OF_WEEK, "funnel_users").orderBy(
            "day_of_week_order"),
        "monthly": segments.against_mean(
            segments.spined(people, D.month_dimension(months), "funnel_users")),
        "hosts": segments.with_market_share(
            segments.spined(people, D.USER_TYPE, "funnel_users")),
        "sort": segments.cut(people, D.SEARCH_SORT, "funnel_users"),
        "category": segments.cut(people, D.TERM_CATEGORY, "funnel_users"),
        "geography": segments.ranked(segments.spined(
            people, D.GEOGRAPHY, "funnel_users", "total_users", "converting_users"), D.GEOGRAPHY),
        "peak_hours": segments.ranked(segments.spined(
            people, D.PEAK, "funnel_users", "total_users", "converting_users"), D.PEAK),
        "position": position.numbered(by_position).orderBy("search_position"),
        "position_buckets": segments.spined(
            clickers, D.POSITION_BUCKET, "approved_users", "total_clickers", "converting_users")
        .orderBy("position_bucket_order"),
        "position_buckets_estimated": position.estimated_bucket_conversion(views, approved),
        "clicks": position.click_distribution(views),
        "sort_activity": position.sort_conversion(searches, tables.views),
    }, store)


def characteristic_rates(people: DataFrame, clickers: DataFrame, by_type: DataFrame,
                         months: range = D.MONTHS) -> DataFrame:
    """(analysis, characteristic, conversion_rate) of all eleven analyses.

    From the two populations and the result of ``search_type_performance``. Weekdays,
    positions and buckets have all their labels, the others those that have users.
    """
    def of(df: DataFrame, analysis: str, column: str) -> DataFrame:
        return insights.rated(df, analysis, column)

    last, first = D.position_dimension(position.LAST_POSITION), D.position_dimension(10)
    long = [of(segments.cut(people, d, "funnel_users"), d.name, d.name) for d in (
        D.SEARCH_SORT, D.TERM_CATEGORY, D.GEOGRAPHY, D.USER_TYPE, D.PEAK,
        D.month_dimension(months))]
    named = F.concat(F.lit("Position "), F.col("search_position"))
    return reduce(DataFrame.unionByName, [
        *long,
        of(segments.spined(people, D.DAY_OF_WEEK, "funnel_users"), "day_of_week", "day_of_week"),
        of(segments.spined(clickers, first, "funnel_users").withColumn("search_position", named),
           "search_position", "search_position"),
        of(segments.spined(clickers, last, "reservers").withColumn("search_position", named),
           "clicked_position", "search_position"),
        of(segments.spined(clickers, D.POSITION_BUCKET, "approved_users"),
           "position_bucket", "position_bucket"),
        of(by_type.where(F.col("search_type").isNotNull()), "search_type", "search_type"),
    ])


def insight_report(tables: Tables, months: range = D.MONTHS) -> Bundle:
    """Best, worst and gap per analysis, the best characteristics and the opportunities."""
    humans = tables.linked().without_bots()
    searches, views, _ = humans.facts()
    store = Store()
    people = store.share(searcher_population(humans, months))
    clickers = store.share(clicker_population(humans))
    by_type = store.share(joined.search_type_performance(searches, views))
    extremes = store.share(insights.extremes(
        characteristic_rates(people, clickers, by_type, months), title_label))
    funnel = people.where(F.col("dimension") == D.ALL.name).agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{name}") for c, name in (
            ("users", "searchers"), ("viewers", "viewers"), ("reservers", "reservers"))])
    return Bundle({
        "extremes": extremes,
        "top_characteristics": insights.top_characteristics(extremes),
        "opportunities": insights.opportunities(
            funnel, by_type, payments.payment_summary(tables.reservations)),
    }, store)


def _by_dimension(long: DataFrame, names: Sequence[str], rate: str) -> dict[str, DataFrame]:
    return {
        name: long.where(F.col("dimension") == name).drop("dimension")
        .orderBy(F.desc(rate), "segment")
        for name in names
    }
