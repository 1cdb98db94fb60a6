"""Best, worst and gap tables over result frames, and long-format reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.functions import display_label
from stagewise.functions.rates import pct_or_zero

# Names of the opportunity areas.
AREA_SEARCH_TO_VIEW = "Search-to-View Conversion"
AREA_VIEW_TO_RESERVE = "View-to-Reserve Conversion"
AREA_SEARCH_TYPE = "Search Type Optimization"
AREA_PAYMENT = "Payment Completion"


def rated(result: DataFrame, analysis: str, label: str, rate: str = "conversion_rate") -> DataFrame:
    """A result frame as ``(analysis, characteristic, conversion_rate)``."""
    return result.select(
        F.lit(analysis).alias("analysis"),
        F.col(label).cast("string").alias("characteristic"),
        F.col(rate).alias("conversion_rate"),
    )


def extremes(rates: DataFrame, title=display_label) -> DataFrame:
    """Best and worst characteristic, their gap and the mean rate per analysis.

    Ties go to the characteristic that sorts first. ``title`` makes a heading of a name.
    """
    rate, name = F.col("conversion_rate"), F.col("characteristic")
    best = F.min(F.struct((-rate).alias("r"), name.alias("name")))
    worst = F.min(F.struct(rate.alias("r"), name.alias("name")))
    return (
        rates.where(rate.isNotNull())
        .groupBy("analysis")
        .agg(best.alias("best"), worst.alias("worst"), F.avg(rate).alias("avg_rate"))
        .select(
            "analysis",
            title(F.col("analysis")).alias("title"),
            F.col("best.name").alias("best"),
            (-F.col("best.r")).alias("best_rate"),
            F.col("worst.name").alias("worst"),
            F.col("worst.r").alias("worst_rate"),
            (-F.col("best.r") - F.col("worst.r")).alias("gap_pp"),
            "avg_rate",
        )
    )


def top_characteristics(extreme_rows: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best characteristics over all analyses."""
    return (
        extreme_rows.select("analysis", "best", "best_rate")
        .orderBy(F.desc("best_rate"), "analysis")
        .limit(n)
    )


def opportunities(funnel: DataFrame, by_search_type: DataFrame, payments: DataFrame) -> DataFrame:
    """Where users are lost: current rate and recoverable count per area.

    The inputs are the results of ``funnel_counts``, ``search_type_performance`` and
    ``payment_summary``.
    """
    def row(df: DataFrame, area: str, rate, recoverable=None, best=None, worst=None):
        return df.select(
            F.lit(area).alias("area"),
            rate.cast("double").alias("current_rate"),
            (F.lit(None) if recoverable is None else recoverable).cast("bigint")
            .alias("recoverable"),
            (F.lit(None) if best is None else best).cast("string").alias("best"),
            (F.lit(None) if worst is None else worst).cast("string").alias("worst"),
        )

    searchers, viewers = F.col("total_searchers"), F.col("total_viewers")
    reservers = F.col("total_reservers")
    # One wide row per stage, so that the funnel is computed once for both areas.
    stages = funnel.select(F.stack(
        F.lit(2),
        F.lit(AREA_SEARCH_TO_VIEW), pct_or_zero(viewers, searchers), searchers - viewers,
        F.lit(AREA_VIEW_TO_RESERVE), pct_or_zero(reservers, viewers), viewers - reservers,
    ).alias("area", "current_rate", "recoverable")).select(
        "area", "current_rate", "recoverable",
        F.lit(None).cast("string").alias("best"), F.lit(None).cast("string").alias("worst"))
    types = extremes(rated(by_search_type.where(F.col("search_type").isNotNull()),
                           "search_type", "search_type"))
    return (
        stages
        .unionByName(row(types, AREA_SEARCH_TYPE, F.col("gap_pp"), None,
                         F.col("best"), F.col("worst")))
        .unionByName(row(payments, AREA_PAYMENT, F.col("payment_completion_rate"),
                         F.col("pending_payments")))
    )


def long_format(
    result: DataFrame, analysis: str, segment: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """A result frame as ``(analysis_type, segment, metric, value)`` rows."""
    label = (
        F.concat_ws(" / ", *[F.coalesce(F.col(s).cast("string"), F.lit("(none)"))
                             for s in segment])
        if segment else F.lit("(all)")
    )
    return result.select(
        F.lit(analysis).alias("analysis_type"), label.alias("segment"),
        F.stack(F.lit(len(metrics)),
                *[c for m in metrics for c in (F.lit(m), F.col(m).cast("double"))])
        .alias("metric", "value"),
    )


def tagged_report(parts: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One long table of several analyses.

    ``parts`` maps the tag of an analysis to its result and the result's segment
    columns; every other column is a metric.
    """
    return reduce(DataFrame.unionByName, [
        long_format(df, tag, segment, [c for c in df.columns if c not in segment])
        for tag, (df, segment) in parts.items()
    ])
