"""Segment performance through one-to-many joins, without building the joined rows.

The straight form joins searches to views (and views to reservations) and counts
distinct users per segment over the product. The product can be thousands of times the
input. Distinct counts only need distinct (segment, key) and (key, user) pairs, and a
mean over the product is a mean weighted by the number of matches; both are computed
from sides that are aggregated before they are joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import label_order, pct, pct_or_zero
from stagewise.functions.buckets import RESULT_COUNT_ELSE, RESULT_COUNT_RANGES
from stagewise.operators import dimensions as D
from stagewise.operators.dimensions import MONTHS
from stagewise.operators.users import has
from stagewise.schemas import RENTER, USER

MIN_ATTRIBUTION_USERS = 10
MIN_DMA_USERS = 50
TOP_N = 10
HOURS = range(0, 24)


def view_performance(
    searches: DataFrame, views: DataFrame, segment: Sequence[str],
    min_searchers: int = 0, averages: bool = False,
) -> DataFrame:
    """Searchers, viewers of their searches and searches per segment.

    Searches meet views on ``search_id``. With ``averages``, ``avg_results`` weighs a
    search by its number of views (at least 1), as a mean over the joined rows does, and
    ``avg_results_unweighted`` is the plain mean.

    Each side is grouped once. Searches then go by search id, views by search id too, and
    everything that is counted is one list of signed rows: a search counts its results once,
    each view of it once more, and a marker row of the viewed search takes one away. One
    grouping by (segment, person) and one by segment add the list up.
    """
    segment = list(segment)
    zero = F.lit(0).cast("bigint")
    sums = [F.sum(F.col("count_results").cast("bigint")).alias("results"),
            F.count("count_results").alias("counted")] if averages else [
        F.max(zero).alias("results"), F.max(zero).alias("counted")]
    grouped = searches.groupBy(*segment, "search_id", F.col(USER).alias("person")).agg(*sums)
    searched = grouped.select(
        *segment, "person", F.lit(_SEARCHER).alias("role"), F.lit(0).alias("searches"),
        "results", "counted", F.lit(1).alias("weight"))
    # By search id alone, so that the grouping and the join need no further shuffle.
    per_search = (
        grouped.where(F.col("search_id").isNotNull()).repartition("search_id")
        .groupBy("search_id", *segment)
        .agg(F.sum("results").alias("results"), F.sum("counted").alias("counted"))
        .where(F.col("search_id").isNotNull())
    )
    person = F.col(USER).cast(searches.schema[USER].dataType)
    known = views.where(F.col("search_id").isNotNull())
    # Beside each view stands its search's marker, which is counted once however many there are.
    matches = (
        known.select("search_id", F.stack(
            F.lit(2), person, F.lit(_VIEWER), F.lit(None).cast(searches.schema[USER].dataType),
            F.lit(_NOBODY)).alias("person", "role"))
        .groupBy("search_id", "person", "role").agg(F.count("*").alias("matches"))
        .withColumn("weight", F.when(F.col("role") == _VIEWER, F.col("matches")).otherwise(-1))
    )
    linked = per_search.join(matches, "search_id").select(
        *segment, "person", "role", F.lit(0).alias("searches"), "results", "counted", "weight")
    once = per_search.select(
        *segment, F.lit(None).cast(searches.schema[USER].dataType).alias("person"),
        F.lit(_NOBODY).alias("role"), F.lit(1).alias("searches"),
        "results", "counted", F.lit(0).alias("weight"))  # all columns: the same shuffle
    own = F.col("role") == _SEARCHER
    people = (
        searched.unionByName(linked).unionByName(once)
        .groupBy(*segment, "person")
        .agg(
            F.bit_or("role").alias("roles"), F.sum("searches").alias("searches"),
            *[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("results", "counted")],
            *[F.sum(F.when(own, F.col(c))).alias(f"plain_{c}") for c in ("results", "counted")])
    )
    somebody = F.col("person").isNotNull()
    totals = people.groupBy(*segment).agg(
        F.count_if(somebody & has("roles", _SEARCHER)).alias("unique_searchers"),
        F.count_if(somebody & has("roles", _VIEWER)).alias("unique_viewers"),
        F.sum("searches").alias("total_searches"),
        _mean(F.sum("results"), F.sum("counted")).alias("avg_results"),
        _mean(F.sum("plain_results"), F.sum("plain_counted")).alias("avg_results_unweighted"))
    means = ["avg_results", "avg_results_unweighted"] if averages else []
    return totals.where(F.col("unique_searchers") >= min_searchers).select(
        *segment, "unique_searchers", "unique_viewers", "total_searches", *means,
        pct(F.col("unique_viewers"), F.col("unique_searchers")).alias("conversion_rate"))


_NOBODY, _SEARCHER, _VIEWER = 0, 1, 2


def search_type_performance(searches: DataFrame, views: DataFrame) -> DataFrame:
    return view_performance(searches, views, ["search_type"], averages=True).orderBy(
        F.desc("conversion_rate"), "search_type")


def category_performance(searches: DataFrame, views: DataFrame) -> DataFrame:
    return view_performance(
        searches, views, ["search_term_category"], averages=True).orderBy(
        F.desc("unique_searchers"), "search_term_category")


def attribution_performance(
    searches: DataFrame, views: DataFrame,
    min_searchers: int = MIN_ATTRIBUTION_USERS, n: int = TOP_N,
) -> DataFrame:
    """The ``n`` largest source and channel pairs with enough searchers."""
    keys = ["first_attribution_source", "first_attribution_channel"]
    return (
        view_performance(searches, views, keys, min_searchers)
        .orderBy(F.desc("unique_searchers"), *keys)
        .limit(n)
    )


def result_count_performance(cleaned_searches: DataFrame, views: DataFrame) -> DataFrame:
    """Performance by number of results, in the order of the categories."""
    labels = [label for _, _, label in RESULT_COUNT_RANGES] + [RESULT_COUNT_ELSE]
    return (
        view_performance(cleaned_searches, views, ["result_count_category"])
        .withColumn("label_order", label_order(F.col("result_count_category"), labels))
        .orderBy("label_order")
    )


def dma_performance(
    searches: DataFrame, views: DataFrame, reservations: DataFrame,
    min_searchers: int = MIN_DMA_USERS, n: int = TOP_N,
) -> DataFrame:
    """Markets: searchers, viewers in the market, and renters of listings viewed there.

    Searches meet views on the market itself; reservations hang off the viewed listing.
    """
    searched = searches.groupBy("search_dma").agg(
        F.countDistinct(USER).alias("unique_searchers"))
    in_market = views.where(F.col("click_dma").isNotNull()).withColumnRenamed(
        "click_dma", "search_dma")
    viewed = in_market.groupBy("search_dma").agg(F.countDistinct(USER).alias("unique_viewers"))
    listings = in_market.where(F.col("listing_id").isNotNull()).select(
        "search_dma", "listing_id").distinct()
    bookings = (
        reservations.where(F.col("listing_id").isNotNull())
        .groupBy("listing_id", RENTER)
        .agg(F.bool_or(F.col("successful_payment_collected_at").isNotNull()).alias("paid"))
    )
    reserved = (
        listings.join(bookings, "listing_id")
        .groupBy("search_dma", RENTER)
        .agg(F.bool_or("paid").alias("paid"))
        .groupBy("search_dma")
        .agg(F.count(RENTER).alias("unique_reservers"),
             F.count(F.when(F.col("paid"), F.col(RENTER))).alias("unique_payers"))
    )
    searchers, viewers = F.col("unique_searchers"), F.col("unique_viewers")
    reservers, payers = F.col("unique_reservers"), F.col("unique_payers")
    return (
        searched.where(searchers >= min_searchers)
        .join(viewed, "search_dma", "left")
        .join(reserved, "search_dma", "left")
        .fillna(0, ["unique_viewers", "unique_reservers", "unique_payers"])
        .withColumns({
            "search_to_view_rate": pct(viewers, searchers),
            "view_to_reserve_rate": pct(reservers, viewers),
            "reserve_to_pay_rate": pct(payers, reservers),
        })
        .orderBy(F.desc("unique_searchers"), "search_dma")
        .limit(n)
    )


def monthly_trends(
    searches: DataFrame, views: DataFrame, reservations: DataFrame,
    reservation_month: Column | None = None, months: range = MONTHS,
) -> DataFrame:
    """Users per stage and month; years fall together.

    Here the segment is the join key, so no rows have to be joined: a user's months are bits
    of one mask per stage, in one grouping by user, and search ids are one distinct set.
    Months outside ``months`` are left out; a NULL month has a row of its own.
    """
    month = F.month("created_at") if reservation_month is None else reservation_month
    paid = F.col("successful_payment_collected_at").isNotNull()
    users = _users_per_label(months, {
        "unique_searchers": user_labels(searches, USER, F.col("month"), known=False),
        "unique_viewers": user_labels(views, USER, F.col("month")),
        "unique_reservers": user_labels(reservations, RENTER, month),
        "unique_payers": user_labels(reservations.where(paid), RENTER, month),
    })
    volume = _searches_per_label(searches, F.col("month"), months)
    return (
        volume.join(users, volume["label"].eqNullSafe(users["place"] + months.start), "left")
        .fillna(0, ["unique_searchers", "unique_viewers", "unique_reservers", "unique_payers"])
        .select(
            F.col("label").alias("month"), "unique_searchers", "unique_viewers",
            "unique_reservers", "unique_payers", "total_searches", "avg_search_results",
            pct_or_zero(F.col("unique_viewers"), F.col("unique_searchers"))
            .alias("search_to_view_rate"))
        .orderBy("month")
    )


def hourly_patterns(cleaned_searches: DataFrame, cleaned_views: DataFrame) -> DataFrame:
    """Searchers, viewers and searches per hour of the day; counted as the months are."""
    users = _users_per_label(HOURS, {
        "unique_searchers": user_labels(cleaned_searches, USER, F.col("search_hour"), False),
        "unique_viewers": user_labels(cleaned_views, USER, F.col("view_hour")),
    })
    volume = _searches_per_label(cleaned_searches, F.col("search_hour"), HOURS)
    return (
        volume.join(users, volume["label"].eqNullSafe(users["place"]), "left")
        .fillna(0, ["unique_searchers", "unique_viewers"])
        .select(F.col("label").alias("search_hour"), "unique_searchers", "total_searches",
                "unique_viewers",
                pct(F.col("unique_viewers"), F.col("unique_searchers")).alias("conversion_rate"))
        .orderBy("search_hour")
    )


def user_labels(df: DataFrame, user: str, label: Column, known: bool = True) -> DataFrame:
    """(user_id, label) of every row, or of those with a label."""
    rows = df.select(F.col(user).alias("user_id"), label.alias("label"))
    return rows.where(F.col("label").isNotNull()) if known else rows


def _users_per_label(labels: range, sets: Mapping[str, DataFrame]) -> DataFrame:
    """place and one count of distinct users per set, for each whole number of a list.

    One grouping by user with one mask per set. A NULL label is place NULL.
    """
    numbers = D.number_dimension("label", labels)
    if len(numbers.labels) >= D.WORD:
        raise ValueError("a list of labels that fits in one mask, please")
    # The last bit stands for no label.
    none = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(len(numbers.labels)))
    rows = [
        users.where(F.col("user_id").isNotNull()).select("user_id", *[
            (F.when(F.col("label").isNull(), none).otherwise(numbers.mask())
             if name == own else F.lit(0).cast("bigint")).alias(own) for own in sets])
        for name, users in sets.items()]
    masks = reduce(DataFrame.unionByName, rows).groupBy("user_id").agg(
        *[F.bit_or(name).alias(name) for name in sets])
    present = reduce(lambda a, b: a.bitwiseOR(b), [F.col(name) for name in sets])
    bits = F.filter(F.sequence(F.lit(0), F.lit(len(numbers.labels))),
                    lambda i: F.getbit(F.col("present"), i) == 1)
    inside = {name: F.getbit(F.col(name), F.col("bit")) == 1 for name in sets}
    return (
        masks.withColumn("present", present)
        .select(*sets, F.explode(bits).alias("bit"))
        .groupBy("bit").agg(*[F.count_if(i).alias(name) for name, i in inside.items()])
        .select(F.when(F.col("bit") < len(numbers.labels), F.col("bit")).alias("place"), *sets)
    )


def _searches_per_label(searches: DataFrame, label: Column, labels: range) -> DataFrame:
    """label, distinct searches and mean number of results, from one row per search id."""
    inside = searches.where(F.coalesce(label.between(labels.start, labels[-1]), F.lit(True)))
    per_search = inside.groupBy(label.alias("label"), "search_id").agg(
        F.sum(F.col("count_results").cast("bigint")).alias("results"),
        F.count("count_results").alias("counted"))
    return per_search.groupBy("label").agg(
        F.count("search_id").alias("total_searches"),
        _mean(F.sum("results"), F.sum("counted")).alias("avg_search_results"))


def _mean(total: Column, count: Column) -> Column:
    return F.round(F.try_divide(total.cast("double"), count), 2)
