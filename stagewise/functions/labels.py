"""Derived labels and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of derived categories.
HOST_LABELS = ("Hosts", "Non-Hosts")
GEO_LABELS = ("USA/Canada", "International")
PEAK_LABELS = ("Peak Hours (9-17)", "Off-Peak Hours")
PEAK_HOURS = (9, 17)
STATUS_COMPLETED = "Completed"
STATUS_PENDING_PAYMENT = "Pending Payment"
STATUS_PENDING_APPROVAL = "Pending Approval"


def boolean_label(flag: Column, labels: tuple[str, str]) -> Column:
    """``labels[0]`` for true, ``labels[1]`` for false, NULL for NULL."""
    return F.when(flag, F.lit(labels[0])).when(~flag, F.lit(labels[1]))


def in_peak_hours(ts: Column) -> Column:
    low, high = PEAK_HOURS
    return F.hour(ts).between(low, high)


def peak_label(ts: Column) -> Column:
    """Peak or off-peak label of a timestamp, NULL for NULL."""
    return boolean_label(in_peak_hours(ts), PEAK_LABELS)


def reservation_status(approved_at: Column, paid_at: Column) -> Column:
    """Lifecycle status; a payment decides before the approval does."""
    return (
        F.when(paid_at.isNotNull(), F.lit(STATUS_COMPLETED))
        .when(approved_at.isNotNull(), F.lit(STATUS_PENDING_PAYMENT))
        .otherwise(F.lit(STATUS_PENDING_APPROVAL))
    )


def search_session_id(user: Column, ts: Column) -> Column:
    """``user_date``: one key per user and calendar day."""
    return F.concat(user.cast("string"), F.lit("_"), F.to_date(ts).cast("string"))


def source_channel(source: Column, channel: Column) -> Column:
    """``source - channel``, NULL if either is NULL."""
    return F.concat(source, F.lit(" - "), channel)


def display_label(name: Column) -> Column:
    """``search_sort`` becomes ``SEARCH SORT``."""
    return F.upper(F.replace(name, F.lit("_"), F.lit(" ")))


def title_label(name: Column) -> Column:
    """``search_sort`` becomes ``Search Sort``."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
