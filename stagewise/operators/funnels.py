"""Overall funnels, funnels by segment, drop-off and the effect of bots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import pct_change, pct_or_zero, source_channel
from stagewise.operators.identity import resolve_renters
from stagewise.operators.users import (
    CLICKED,
    PAID,
    RESERVED,
    SEARCHED,
    USER_ID,
    has,
    later_stages,
    renters,
    user_ids,
    user_stages,
)
from stagewise.schemas import RENTER, USER


def funnel_counts(
    searches: DataFrame,
    views: DataFrame,
    reservations: DataFrame,
    identity_map: DataFrame | None = None,
) -> DataFrame:
    """Searchers and how many of them viewed, reserved and paid, with rates and losses.

    Each later stage is counted among searchers on its own: a reserver need not have
    viewed, so the counts need not fall from stage to stage.
    """
    if identity_map is not None:
        # One row per renter before the map is joined, however often a renter reserved.
        paid_at = "successful_payment_collected_at"
        per_renter = reservations.groupBy(RENTER).agg(F.max(paid_at).alias(paid_at))
        reservations = resolve_renters(per_renter, identity_map)
    users = user_stages(searches, views, reservations)
    counts = users.agg(
        F.count_if(has("stages", SEARCHED)).alias("total_searchers"),
        F.count_if(has("stages", SEARCHED | CLICKED)).alias("total_viewers"),
        F.count_if(has("stages", SEARCHED | RESERVED)).alias("total_reservers"),
        F.count_if(has("stages", SEARCHED | PAID)).alias("total_payers"),
    )
    return with_losses(counts)


def with_losses(counts: DataFrame) -> DataFrame:
    """The four stage counts with their rates and losses."""
    searchers, viewers = F.col("total_searchers"), F.col("total_viewers")
    reservers, payers = F.col("total_reservers"), F.col("total_payers")
    rated = counts.withColumns({
        "search_to_view_rate": pct_or_zero(viewers, searchers),
        "view_to_reserve_rate": pct_or_zero(reservers, viewers),
        "reserve_to_pay_rate": pct_or_zero(payers, reservers),
        "overall_rate": pct_or_zero(payers, searchers),
        "lost_after_search": searchers - viewers,
        "lost_after_view": viewers - reservers,
        "lost_after_reserve": reservers - payers,
    })
    return rated.withColumns({
        "search_dropoff_pct": F.lit(100.0) - F.col("search_to_view_rate"),
        "view_dropoff_pct": F.lit(100.0) - F.col("view_to_reserve_rate"),
        "reserve_dropoff_pct": F.lit(100.0) - F.col("reserve_to_pay_rate"),
    })


def funnel_overlap(searches: DataFrame, views: DataFrame, reservations: DataFrame) -> DataFrame:
    """Distinct users per stage and in the stage intersections, with three rates."""
    return (
        user_stages(searches, views, reservations)
        .agg(
            F.count_if(has("stages", SEARCHED)).alias("total_searchers"),
            F.count_if(has("stages", CLICKED)).alias("total_clickers"),
            F.count_if(has("stages", RESERVED)).alias("total_reservers"),
            *_overlap_counts("stages"),
        )
        .withColumns(_overlap_rates())
    )


def funnel_by_segment(
    searches: DataFrame,
    views: DataFrame,
    reservations: DataFrame,
    segment: Column,
    name: str,
    null_segment: str = "drop",
    ordered: bool = True,
) -> DataFrame:
    """The overlap funnel for the users of every segment value of the searches.

    A user counts in each segment they searched in. Clicks and reservations are those of
    the segment's users anywhere, so clickers of a segment all searched in it.
    """
    pairs = searches.select(F.col(USER).alias(USER_ID), segment.alias(name))
    pairs = pairs.where(F.col(USER_ID).isNotNull())
    if null_segment == "drop":
        pairs = pairs.where(F.col(name).isNotNull())
    elif null_segment != "keep":
        raise ValueError("null_segment is 'drop' or 'keep'")
    later = later_stages(views, reservations)
    clicked, reserved = has("stages", CLICKED), has("stages", RESERVED)
    result = (
        pairs.distinct()
        .join(later, USER_ID, "left")
        .groupBy(name)
        .agg(
            F.count("*").alias("total_searchers"),
            F.count_if(clicked).alias("total_clickers"),
            F.count_if(reserved).alias("total_reservers"),
            F.count_if(clicked).alias("searched_and_clicked"),
            F.count_if(clicked & reserved).alias("searched_clicked_reserved"),
        )
        .withColumns(_overlap_rates())
    )
    return result.orderBy(F.desc("search_to_reserve_rate"), name) if ordered else result


def funnel_by_channel(searches, views, reservations, **options) -> DataFrame:
    """:func:`funnel_by_segment` on the first attribution channel."""
    return funnel_by_segment(
        searches, views, reservations, F.col("first_attribution_channel"), "channel", **options
    )


def funnel_by_source_channel(searches, views, reservations, **options) -> DataFrame:
    """:func:`funnel_by_segment` on source and channel together."""
    return funnel_by_segment(
        searches, views, reservations, _source_channel(), "source_channel", **options
    )


def source_channel_volume(searches: DataFrame) -> DataFrame:
    """Searches per source and channel combination."""
    return (
        searches.select(_source_channel().alias("source_channel"))
        .where(F.col("source_channel").isNotNull())
        .groupBy("source_channel")
        .agg(F.count("*").alias("searches"))
    )


def with_support(result: DataFrame, column: str, minimum: int) -> DataFrame:
    """Rows whose count in ``column`` reaches ``minimum``."""
    return result.where(F.col(column) >= minimum)


def top(result: DataFrame, n: int, by: str, *tie_break: str) -> DataFrame:
    """The ``n`` rows with the largest ``by``; ties go to the smaller ``tie_break``."""
    return result.orderBy(F.desc(by), *tie_break).limit(n)


def dropoff(searches: DataFrame, views: DataFrame, reservations: DataFrame) -> DataFrame:
    """Users lost between stages and searchers who never completed the funnel.

    The loss after the click is measured on all clickers, whether they searched or not.
    """
    searched, clicked = has("stages", SEARCHED), has("stages", CLICKED)
    reserved = has("stages", RESERVED)
    counts = user_stages(searches, views, reservations).agg(
        F.count_if(searched).alias("total_searchers"),
        F.count_if(clicked).alias("total_clickers"),
        F.count_if(searched & ~clicked).alias("searched_not_clicked"),
        F.count_if(clicked & ~reserved).alias("clicked_not_reserved"),
        F.count_if(searched & ~(clicked & reserved)).alias("non_converting_searchers"),
    )
    searchers = F.col("total_searchers")
    return counts.withColumns({
        "search_to_click_dropoff_rate": pct_or_zero(F.col("searched_not_clicked"), searchers),
        "click_to_reserve_dropoff_rate": pct_or_zero(
            F.col("clicked_not_reserved"), F.col("total_clickers")),
        "non_conversion_rate": pct_or_zero(F.col("non_converting_searchers"), searchers),
    })


def bot_impact(searches: DataFrame, views: DataFrame, reservations: DataFrame) -> DataFrame:
    """The overlap funnel with and without bot events, and the change bots make.

    Both sides come from one grouping: events of bots set only the first mask. Events
    whose bot flag is NULL count as bots. Reservations carry no flag and count in both.
    """
    human = F.coalesce(~F.col("is_bot"), F.lit(False))
    rows = (
        _flagged(searches, USER, SEARCHED, human)
        .unionByName(_flagged(views, USER, CLICKED, human))
        .unionByName(_flagged(reservations, RENTER, RESERVED, F.lit(True)))
    )
    users = rows.groupBy(USER_ID).agg(
        F.bit_or("stages").alias("all_stages"),
        F.bit_or(F.when(F.col("human"), F.col("stages")).otherwise(0)).alias("human_stages"),
    )
    full = SEARCHED | CLICKED | RESERVED
    aggregates = []
    for side, mask in (("all", "all_stages"), ("non_bot", "human_stages")):
        aggregates += [
            F.count_if(has(mask, SEARCHED)).alias(f"{side}_searchers"),
            F.count_if(has(mask, CLICKED)).alias(f"{side}_clickers"),
            F.count_if(has(mask, SEARCHED | CLICKED)).alias(f"{side}_searched_and_clicked"),
            F.count_if(has(mask, full)).alias(f"{side}_funnel_users"),
        ]
    aggregates.append(F.count_if(has("all_stages", RESERVED)).alias("total_reservers"))
    rates = {}
    for side in ("all", "non_bot"):
        searchers = F.col(f"{side}_searchers")
        both, funnel = F.col(f"{side}_searched_and_clicked"), F.col(f"{side}_funnel_users")
        rates[f"{side}_search_to_click_rate"] = pct_or_zero(both, searchers)
        rates[f"{side}_click_to_reserve_rate"] = pct_or_zero(funnel, both)
        rates[f"{side}_search_to_reserve_rate"] = pct_or_zero(funnel, searchers)
    return users.agg(*aggregates).withColumns(rates).withColumns({
        "searcher_change_pct": pct_change(F.col("non_bot_searchers"), F.col("all_searchers")),
        "funnel_change_pct": pct_change(F.col("non_bot_funnel_users"), F.col("all_funnel_users")),
        "rate_change_pp": F.col("non_bot_search_to_reserve_rate")
        - F.col("all_search_to_reserve_rate"),
    })


def _flagged(df: DataFrame, user: str, stage: int, human: Column) -> DataFrame:
    return df.where(F.col(user).isNotNull()).select(
        F.col(user).alias(USER_ID), F.lit(stage).alias("stages"), human.alias("human")
    )


def linkage_check(searches: DataFrame, views: DataFrame, reservations: DataFrame) -> DataFrame:
    """Clicks and reservations of every searcher under direct equality of ids."""
    def events(df: DataFrame, search: int, click: int, reserve: int) -> DataFrame:
        return df.select(USER_ID, F.lit(search).alias("s"), F.lit(click).alias("c"),
                         F.lit(reserve).alias("r"))

    rows = (
        events(user_ids(searches), 1, 0, 0)
        .unionByName(events(user_ids(views), 0, 1, 0))
        .unionByName(events(renters(reservations), 0, 0, 1))
    )
    return (
        rows.groupBy(USER_ID)
        .agg(F.sum("s").alias("searches"), F.sum("c").alias("clicks"),
             F.sum("r").alias("reservations"))
        .where("searches > 0")
    )


def _source_channel() -> Column:
    return source_channel(F.col("first_attribution_source"), F.col("first_attribution_channel"))


def _overlap_counts(mask: str) -> list[Column]:
    return [
        F.count_if(has(mask, SEARCHED | CLICKED)).alias("searched_and_clicked"),
        F.count_if(has(mask, SEARCHED | CLICKED | RESERVED)).alias("searched_clicked_reserved"),
    ]


def _overlap_rates() -> dict[str, Column]:
    searchers, both = F.col("total_searchers"), F.col("searched_and_clicked")
    full = F.col("searched_clicked_reserved")
    return {
        "search_to_click_rate": pct_or_zero(both, searchers),
        "click_to_reserve_rate": pct_or_zero(full, both),
        "search_to_reserve_rate": pct_or_zero(full, searchers),
    }
