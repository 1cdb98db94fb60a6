"""Resolution of the two id spaces: accounts that reserve and ids that search and view.

Reservations name the account (``user_id`` of the identity map), events the searcher
(``merged_amplitude_id``). Resolving replaces the account by its searcher once, so that
every operator can then compare users directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.schemas import RENTER, USER

UNMATCHED = ("drop", "keep")
SHARED = ("all", "least")
ACCOUNT = "user_id"


def account_searchers(identity_map: DataFrame, shared: str = "all") -> DataFrame:
    """(account, searcher): the distinct pairs of the map, without NULLs.

    Several accounts of one searcher are several rows. Of an account that several searchers
    share, ``all`` keeps every pair and ``least`` the smallest searcher.
    """
    if shared not in SHARED:
        raise ValueError(f"shared is one of {SHARED}")
    known = identity_map.select(F.col(ACCOUNT).alias("account"), F.col(USER).alias("searcher")).where(
        F.col("account").isNotNull() & F.col("searcher").isNotNull())
    if shared == "least":
        return known.groupBy("account").agg(F.min("searcher").alias("searcher"))
    return known.distinct()


def resolve_renters(
    reservations: DataFrame, identity_map: DataFrame,
    unmatched: str = "drop", shared: str = "all",
) -> DataFrame:
    """``reservations`` with the searcher's id in place of the account's, all columns kept.

    A reservation whose account the map does not know drops out, or with ``keep`` stays with
    a NULL renter: it is nobody's in every count of users, but a reservation of its listing
    and its month still. A reservation without a renter is treated alike. With
    ``shared="all"`` a reservation of a shared account is a row for each of its searchers,
    as a join with the map gives it; with ``least`` no row is ever repeated.
    """
    if unmatched not in UNMATCHED:
        raise ValueError(f"unmatched is one of {UNMATCHED}")
    pairs = account_searchers(identity_map, shared)
    columns = reservations.columns
    how = "inner" if unmatched == "drop" else "left"
    return reservations.join(pairs, reservations[RENTER] == pairs["account"], how).select(
        *[F.col("searcher").alias(c) if c == RENTER else reservations[c] for c in columns])


def unmatched_renters(reservations: DataFrame, identity_map: DataFrame) -> DataFrame:
    """Accounts that reserved but are in no row of the map, with their reservations."""
    pairs = account_searchers(identity_map).select("account").distinct()
    return (
        reservations.where(F.col(RENTER).isNotNull())
        .groupBy(F.col(RENTER).alias("account")).agg(F.count("*").alias("reservations"))
        .join(pairs, "account", "left_anti")
    )
