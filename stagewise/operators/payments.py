"""Payment lifecycle of reservations.

"Rejected" means not approved, so it includes pending approvals, and a reservation paid
without approval counts as both successful and rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions import hours_between, pct, pct_or_zero


def payment_summary(reservations: DataFrame) -> DataFrame:
    """Counts per payment outcome, completion rate and mean waiting times."""
    created = F.col("created_at")
    successful = F.count_if(_paid())
    return reservations.agg(
        *_outcomes(),
        pct(successful, F.count("*")).alias("payment_completion_rate"),
        F.round(F.avg(hours_between(created, F.col("approved_at"))), 2)
        .alias("avg_hours_to_approval"),
        F.round(F.avg(hours_between(created, F.col("successful_payment_collected_at"))), 2)
        .alias("avg_hours_to_payment"),
    )


def monthly_payments(reservations: DataFrame) -> DataFrame:
    """Reservations, payments and completion rate per month of creation."""
    return (
        reservations.groupBy(F.month("created_at").alias("reservation_month"))
        .agg(
            F.count("*").alias("total_reservations"),
            F.count_if(_paid()).alias("successful_payments"),
            pct(F.count_if(_paid()), F.count("*")).alias("payment_completion_rate"),
        )
        .orderBy("reservation_month")
    )


def payment_status(reservations: DataFrame) -> DataFrame:
    """Reservations per outcome and their share of the sum of the outcomes."""
    summary = reservations.agg(*_outcomes())
    total = F.sum("reservations").over(Window.partitionBy())
    return (
        summary.select(F.stack(
            F.lit(3),
            F.lit("Successful"), F.col("successful_payments"),
            F.lit("Pending"), F.col("pending_payments"),
            F.lit("Rejected"), F.col("rejected_reservations"),
        ).alias("payment_status", "reservations"))
        .withColumn("share_pct", pct_or_zero(F.col("reservations"), total))
    )


def lifecycle_status(cleaned_reservations: DataFrame) -> DataFrame:
    """Reservations per exclusive lifecycle status and their share."""
    total = F.sum("reservations").over(Window.partitionBy())
    return (
        cleaned_reservations.groupBy("reservation_status")
        .agg(F.count("*").alias("reservations"))
        .withColumn("share_pct", pct_or_zero(F.col("reservations"), total))
    )


def _paid() -> Column:
    return F.col("successful_payment_collected_at").isNotNull()


def _outcomes() -> list[Column]:
    approved = F.col("approved_at").isNotNull()
    return [
        F.count("*").alias("total_reservations"),
        F.count_if(_paid()).alias("successful_payments"),
        F.count_if(approved & ~_paid()).alias("pending_payments"),
        F.count_if(~approved).alias("rejected_reservations"),
    ]
