"""Reservations per view, by listing and by characteristics of the views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import pct_or_zero
from stagewise.operators.dimensions import Dimension, listing_dimensions

MIN_VIEWS = 50
MIN_TOP_VIEWS = 10
HIGH_VOLUME_VIEWS = 100


def listing_stats(views: DataFrame, reservations: DataFrame) -> DataFrame:
    """Views, reservations and rate of every viewed listing."""
    viewed = (
        views.where(F.col("listing_id").isNotNull())
        .groupBy("listing_id").agg(F.count("*").alias("total_views"))
    )
    return (
        viewed.join(reservations_per_listing(reservations), "listing_id", "left")
        .select(
            "listing_id", "total_views",
            F.coalesce("total_reservations", F.lit(0)).alias("total_reservations"),
            F.col("total_reservations").isNotNull().alias("was_reserved"))
        .withColumn("conversion_rate",
                    pct_or_zero(F.col("total_reservations"), F.col("total_views")))
    )


def reservations_per_listing(reservations: DataFrame) -> DataFrame:
    return (
        reservations.where(F.col("listing_id").isNotNull())
        .groupBy("listing_id").agg(F.count("*").alias("total_reservations"))
    )


def listing_segment_conversion(
    views: DataFrame,
    reservations: DataFrame,
    dimensions: Sequence[Dimension] | None = None,
    min_views: int = MIN_VIEWS,
    ordered: bool = True,
) -> DataFrame:
    """Views per segment against all reservations of the listings seen in it.

    Closed dimensions take one grouping by listing that counts the views of each label in a
    column of its own; open ones a grouping by listing and value. Both combine on the map side,
    so a listing that holds a large part of all views is a few rows by the time it meets the
    reservation counts, and all totals are added up from these rows.
    """
    picked = listing_dimensions() if dimensions is None else dimensions
    booked = reservations_per_listing(reservations)
    closed, opened = _columnar(picked)
    cells = []
    if closed:
        cells.append(_label_cells(views, closed))
    if opened:
        cells.append(_value_cells(views, opened, len(closed)))
    names = F.array(*[F.lit(d.name) for d in (*closed, *opened)])
    labels = F.array(*[d.label_array() for d in closed], F.array(F.lit("")))
    counted = [
        part.join(booked, "listing_id", "left")
        .select("listing_id", "total_reservations", spread)
        .select("listing_id", "total_reservations", "number", "place", "segment", "views")
        .where("views > 0")
        .groupBy("number", "place", "segment")
        .agg(
            F.sum("views").alias("total_views"),
            F.coalesce(F.sum("total_reservations"), F.lit(0)).alias("total_reservations"),
            F.count("listing_id").alias("unique_listings"),
            F.count("total_reservations").alias("reserved_listings"),
        )
        for part, spread in cells
    ]
    result = (
        reduce(DataFrame.unionByName, counted)
        .where(F.col("total_views") >= min_views)
        .select(
            F.get(names, F.col("number")).alias("dimension"),
            F.coalesce("segment", F.get(F.get(labels, F.col("number")), F.col("place")))
            .alias("segment"),
            "total_views", "total_reservations", "unique_listings", "reserved_listings",
            pct_or_zero(F.col("total_reservations"), F.col("total_views"))
            .alias("conversion_rate"),
            pct_or_zero(F.col("reserved_listings"), F.col("unique_listings"))
            .alias("listing_reservation_rate"))
    )
    return result.orderBy(
        "dimension", F.desc("conversion_rate"), "segment") if ordered else result


def _label_cells(views: DataFrame, closed: Sequence[Dimension]) -> tuple[DataFrame, Column]:
    """A row per listing with a count per label, and the expression that makes rows of them."""
    labels = [(i, place) for i, d in enumerate(closed) for place in range(len(d.labels))]
    per_listing = (
        views.select("listing_id", *[d.index().cast("int").alias(f"p{i}")
                                     for i, d in enumerate(closed)])
        .groupBy("listing_id")
        # As text: one call for a label, where columns would take five.
        .agg(*[F.expr(f"count_if(p{i} = {place}) AS c{i}_{place}") for i, place in labels])
    )
    rows = ", ".join(f"{i}, {place}, CAST(NULL AS STRING), c{i}_{place}" for i, place in labels)
    return per_listing, F.expr(
        f"stack({len(labels)}, {rows}) AS (number, place, segment, views)")


def _value_cells(
    views: DataFrame, opened: Sequence[Dimension], first: int
) -> tuple[DataFrame, Column]:
    """A row per listing and value; the numbers of the dimensions begin at ``first``."""
    values = [c for i, d in enumerate(opened, first) for c in (F.lit(i), d.column())]
    per_value = (
        views.select("listing_id", F.stack(F.lit(len(opened)), *values).alias("number", "segment"))
        .where(F.col("segment").isNotNull())
        .groupBy("listing_id", "number", "segment").agg(F.count("*").alias("views"))
    )
    return per_value, F.inline(F.array(F.struct(
        F.col("number").alias("number"), F.lit(None).cast("int").alias("place"),
        F.col("segment").alias("segment"), F.col("views").alias("views"))))


#: Labels that are counted in columns, in all.
WIDE = 80


def _columnar(picked: Sequence[Dimension]) -> tuple[list[Dimension], list[Dimension]]:
    """The closed dimensions whose labels fit into columns, and the others as open ones."""
    closed, opened, used = [], [], 0
    for d in picked:
        if d.closed and used + len(d.labels) <= WIDE:
            closed.append(d)
            used += len(d.labels)
        else:
            opened.append(Dimension(d.name, d.column) if d.closed else d)
        opened += d.outside()
    return closed, opened


def high_volume_listings(
    stats: DataFrame, min_views: int = HIGH_VOLUME_VIEWS, n: int = 10
) -> DataFrame:
    """The ``n`` best converting listings among those with many views."""
    return (
        stats.where(F.col("total_views") >= min_views)
        .drop("was_reserved")
        .orderBy(F.desc("conversion_rate"), "listing_id")
        .limit(n)
    )


def top_listings(stats: DataFrame, min_views: int = MIN_TOP_VIEWS, n: int = 10) -> DataFrame:
    """The ``n`` best converting listings with at least ``min_views`` views."""
    return (
        stats.where(F.col("total_views") >= min_views)
        .orderBy(F.desc("conversion_rate"), "listing_id")
        .limit(n)
    )


def listing_summary(views: DataFrame, reservations: DataFrame) -> DataFrame:
    """Totals over all views and reservations, and distinct listings on each side.

    Reserved listings need not have been viewed, so the listing rate may exceed 100.
    """
    v, r = F.col("v"), F.col("r")
    rows = (
        views.select("listing_id", F.lit(1).alias("v"), F.lit(0).alias("r"))
        .unionByName(reservations.select("listing_id", F.lit(0).alias("v"), F.lit(1).alias("r")))
    )
    known = F.col("listing_id").isNotNull()
    return (
        rows.groupBy("listing_id")
        .agg(F.sum(v).alias("v"), F.sum(r).alias("r"))
        .agg(
            F.coalesce(F.sum(v), F.lit(0)).alias("total_listing_views"),
            F.coalesce(F.sum(r), F.lit(0)).alias("total_reservations"),
            F.count_if(known & (v > 0)).alias("unique_listings_viewed"),
            F.count_if(known & (r > 0)).alias("unique_listings_reserved"),
        )
        .withColumns({
            "overall_conversion_rate": pct_or_zero(
                F.col("total_reservations"), F.col("total_listing_views")),
            "listing_reservation_rate": pct_or_zero(
                F.col("unique_listings_reserved"), F.col("unique_listings_viewed")),
        })
    )
