"""Conversion of users by any dimension of their events.

A user counts once in every segment they touched, and "converted" is a property of the
user: being in every one of the ``evidence`` user sets. Segments overlap, so their rates
neither add up nor average to the overall rate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.functions import bucketize, pct_or_zero
from stagewise.functions.buckets import FREQUENCY_EDGES, FREQUENCY_LABELS, bucket_index
from stagewise.functions.labels import HOST_LABELS
from stagewise.functions.times import WEEKEND
from stagewise.operators import dimensions as D
from stagewise.operators.dimensions import Dimension
from stagewise.operators.users import USER_ID, renters, user_ids
from stagewise.schemas import USER

# Read from the profile of a user, not from an event.
SEARCH_FREQUENCY = D.closed_dimension(
    "search_frequency", FREQUENCY_LABELS,
    lambda: bucket_index(F.col("events"), FREQUENCY_EDGES))
MIN_USERS = 50
MIN_TERM_USERS = 20

# Metric, its count column and its rate column.
METRICS = {
    "converted": ("funnel_users", "conversion_rate"),
    "non_converting": ("non_converting_users", "non_conversion_rate"),
    "never_clicked": ("never_clicked_users", "never_clicked_rate"),
}


def segment_conversion(
    events: DataFrame,
    dimensions: Sequence[Dimension],
    evidence: Sequence[DataFrame],
    metric: str = "converted",
    min_users: int | Mapping[str, int] = MIN_USERS,
    frequency: bool = False,
    null_segment: str = "drop",
    ordered: bool = True,
) -> DataFrame:
    """Users and hits per segment, for many dimensions in one pass.

    ``evidence`` holds the user sets a user of ``events`` must all be in to have
    converted. ``metric`` reports those users, or for ``non_converting`` and
    ``never_clicked`` the others. ``min_users`` is a minimum for all dimensions or one
    per dimension name, with none for a dimension that is not named. ``frequency`` adds the bins of the user's number of events.

    The counts are those of :func:`population`.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {sorted(METRICS)}")
    if null_segment not in ("drop", "keep"):
        raise ValueError("null_segment is drop or keep")
    names = {d.name for d in dimensions} | ({SEARCH_FREQUENCY.name} if frequency else set())
    if not isinstance(min_users, int) and set(min_users) - names:
        raise ValueError(f"min_users names no dimension: {sorted(set(min_users) - names)}")
    sets = {str(i): users for i, users in enumerate(evidence)}
    counts = population(events, dimensions, sets, {"hits": tuple(sets)}, frequency,
                        null_segment).withColumnRenamed("users", "total_searchers")

    count_name, rate_name = METRICS[metric]
    total = F.col("total_searchers")
    hits = F.col("hits") if metric == "converted" else total - F.col("hits")
    result = (
        counts.where(total >= _minimum(min_users))
        .select("dimension", "segment", total, hits.alias(count_name),
                pct_or_zero(hits, total).alias(rate_name))
    )
    return result.orderBy("dimension", F.desc(rate_name), "segment") if ordered else result


def population(
    events: DataFrame,
    dimensions: Sequence[Dimension],
    evidence: Mapping[str | tuple[str, ...], DataFrame],
    hits: Mapping[str, Sequence[str]],
    frequency: bool = False,
    null_segment: str = "drop",
) -> DataFrame:
    """Users, events and hits per segment of any number of dimensions, from one pass.

    ``evidence`` names user sets, or under several names a frame with one flag for each;
    ``hits`` names counts, each of the users that are in all the sets listed for it. The result has columns dimension, segment, place (of the label in a
    closed dimension), users, events (in an open one) and one per count.

    Events and evidence meet in one union and one grouping: a user's row holds the label masks
    of closed dimensions, the number of events and the sets the user is in; beside it stands a
    row for each of the user's values in open dimensions. Both come from the same shuffle, in
    which a user with a large part of all events is one row per task and value. The values
    then meet the user's row in a join that adaptive execution can split.
    """
    closed = [d for d in dimensions if d.closed and null_segment == "drop"]
    opened = [d for d in dimensions if d not in closed]
    opened += [o for d in closed for o in d.outside()]
    words = [w for d in closed for w in d.words()]
    masks = [_mask(w) for w in words]
    grouped = _user_rows(events, words, masks, opened, evidence, null_segment)
    bits = _bits(evidence)
    counted = [
        ((F.col("seen").bitwiseAND(F.lit(need)) == need).alias(name))
        for name, need in ((n, sum(bits[e] for e in names)) for n, names in hits.items())]
    users = grouped.where((F.col("kind") == _PERSON) & (F.col("events") > 0)) if opened \
        else grouped.where("events > 0")
    columns = ["dimension", "segment", "place", "users", "events", *hits]
    parts = []
    if words or frequency:
        labelled, labels = list(words), [F.col(m) for m in masks]
        if frequency:
            labelled.append(SEARCH_FREQUENCY)
            labels.append(SEARCH_FREQUENCY.mask())
        profile = users.select("events", *masks, *counted)
        parts.append(
            D.unfold(profile, labelled, labels, list(hits))
            .groupBy("dimension", "segment", "place")
            .agg(F.count("*").alias("users"), *[F.count_if(h).alias(h) for h in hits])
            .withColumn("events", F.lit(None).cast("bigint")).select(*columns))
    if opened:
        # The conditions name every column, so that both sides keep the same shuffle.
        blank = [F.col(m).isNull() for m in masks] + [F.col("seen") >= 0, F.col("events") >= 0]
        filled = [F.col(m).isNotNull() for m in masks] + [F.col("events") >= 0]
        values = grouped.where(_every(F.col("kind") >= 0, blank)).select(
            USER_ID, "number", "segment", "events")
        people = users.where(_every(F.lit(True), filled)).select(USER_ID, *counted)
        names = F.array(*[F.lit(d.name) for d in opened])
        parts.append(
            values.join(people, USER_ID)
            .groupBy("number", "segment")
            .agg(F.count("*").alias("users"), F.sum("events").alias("events"),
                 *[F.count_if(h).alias(h) for h in hits])
            .withColumns({"dimension": F.get(names, F.col("number")),
                          "place": F.lit(None).cast("int")})
            .select(*columns))
    return reduce(DataFrame.unionByName, parts)


_PERSON = -1


def _bits(evidence: Mapping[str | tuple[str, ...], DataFrame]) -> dict[str, int]:
    names = [n for key in evidence for n in ((key,) if isinstance(key, str) else key)]
    return {name: 1 << i for i, name in enumerate(names)}


def spined(long: DataFrame, dimension: Dimension, hit: str, users: str = "total_searchers",
           hits: str = "funnel_users", name: str | None = None) -> DataFrame:
    """One closed dimension cut from a :func:`population`, zeros for labels without users;
    as :func:`spine_conversion` gives it."""
    name = name or dimension.name
    spine = long.sparkSession.range(1).select(
        F.posexplode(dimension.label_array()).alias("place", name))
    found = long.where(F.col("dimension") == dimension.name).select("place", "users", hit)
    counts = {users: F.coalesce("users", F.lit(0)), hits: F.coalesce(hit, F.lit(0))}
    return spine.join(found, "place", "left").select(
        name, (F.col("place") + 1).alias(f"{name}_order"),
        *[c.alias(n) for n, c in counts.items()],
        pct_or_zero(counts[hits], counts[users]).alias("conversion_rate"))


def cut(long: DataFrame, dimension: Dimension, hit: str) -> DataFrame:
    """One dimension of a :func:`population`, as :func:`single_dimension` gives it."""
    return (
        long.where(F.col("dimension") == dimension.name)
        .select(F.col("segment").alias(dimension.name), F.col("users").alias("total_searchers"),
                F.col(hit).alias("funnel_users"),
                pct_or_zero(F.col(hit), F.col("users")).alias("conversion_rate"))
        .orderBy("conversion_rate", dimension.name)
    )


def _every(first: Column, more: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, more, first)


def _user_rows(
    events: DataFrame, words: Sequence[Dimension], masks: Sequence[str],
    opened: Sequence[Dimension], evidence: Mapping[str, DataFrame], null_segment: str,
) -> DataFrame:
    """One row per user, and with open dimensions one more per user and value."""
    rows = events.where(F.col(USER).isNotNull())
    user, none = F.col(USER).alias(USER_ID), F.lit(None)
    own = [w.mask().alias(m) for w, m in zip(words, masks)]
    keys = [USER_ID]
    if opened:
        keys += ["number", "segment"]
        values = [c for i, d in enumerate(opened) for c in (F.lit(i).cast("tinyint"), d.column())]
        rows = rows.select(user, *own, F.stack(
            F.lit(len(opened) + 1), F.lit(_PERSON).cast("tinyint"), none.cast("string"), *values)
            .alias("number", "segment"))
        person = F.col("number") == _PERSON
        if null_segment == "drop":
            rows = rows.where(person | F.col("segment").isNotNull())
        rows = rows.select(*keys, *[F.when(person, F.col(m)).alias(m) for m in masks])
    else:
        rows = rows.select(user, *own)
    rows = rows.withColumns({"events": F.lit(1), "seen": F.lit(0)})
    bits = _bits(evidence)
    for names, users in evidence.items():
        seen = F.lit(bits[names]) if isinstance(names, str) else reduce(
            lambda a, b: a + b, [F.when(F.col(n), bits[n]).otherwise(0) for n in names])
        rows = rows.unionByName(users.select(
            USER_ID,
            *([F.lit(_PERSON).cast("tinyint").alias("number"),
               none.cast("string").alias("segment")] if opened else []),
            *[F.lit(0).cast("bigint").alias(m) for m in masks],
            F.lit(0).alias("events"), seen.alias("seen")))
    # As an aggregate, the kind of a row is no reason to read the facts again for each kind.
    kind = [F.max("number").alias("kind")] if opened else []
    return rows.groupBy(*keys).agg(
        *kind, F.sum("events").alias("events"), F.bit_or("seen").alias("seen"),
        *[F.bit_or(m).alias(m) for m in masks])


def search_characteristics(
    searches: DataFrame, views: DataFrame, reservations: DataFrame,
    months: range = D.MONTHS, **options,
) -> DataFrame:
    """Full-funnel conversion by every search characteristic."""
    return segment_conversion(
        searches, D.search_dimensions(months), full_funnel(views, reservations),
        frequency=True, **options)


def non_converting_searches(
    searches: DataFrame, views: DataFrame, reservations: DataFrame,
    months: range = D.MONTHS, **options,
) -> DataFrame:
    """Searchers outside the full funnel by every search characteristic and attribution."""
    return segment_conversion(
        searches, [*D.search_dimensions(months), *D.attribution_dimensions()],
        full_funnel(views, reservations), metric="non_converting", frequency=True, **options)


def never_clicked(searches: DataFrame, views: DataFrame, **options) -> DataFrame:
    """Searchers without any click by search type and term category."""
    return segment_conversion(
        searches, [D.SEARCH_TYPE, D.TERM_CATEGORY], [user_ids(views)],
        metric="never_clicked", **options)


def search_terms(
    searches: DataFrame, views: DataFrame, reservations: DataFrame,
    metric: str = "converted", min_users: int = MIN_TERM_USERS, n: int = 10,
) -> DataFrame:
    """The ``n`` search terms with the highest rate of ``metric``."""
    rate = METRICS[metric][1]
    return (
        segment_conversion(searches, [D.SEARCH_TERM], full_funnel(views, reservations),
                           metric=metric, min_users=min_users, ordered=False)
        .orderBy(F.desc(rate), "segment")
        .limit(n)
    )


def search_frequency(searches: DataFrame) -> DataFrame:
    """Searches of every user and the bin of that number."""
    return (
        user_ids(searches).groupBy(USER_ID).agg(F.count("*").alias("searches"))
        .withColumn("search_frequency",
                    bucketize(F.col("searches"), FREQUENCY_EDGES, FREQUENCY_LABELS))
    )


def full_funnel(views: DataFrame, reservations: DataFrame) -> list[DataFrame]:
    """Evidence that a searcher completed the funnel: a click and a reservation."""
    return [user_ids(views), renters(reservations)]


def spine_conversion(
    events: DataFrame,
    dimension: Dimension,
    evidence: Sequence[DataFrame],
    users: str = "total_searchers",
    hits: str = "funnel_users",
) -> DataFrame:
    """Conversion per label of a closed dimension; labels without users have zeros.

    A row without user and without labels is added to the users, so every label is
    present even for empty input.
    """
    masks = [_mask(w) for w in dimension.words()]
    profile = _profile(events, dimension.words(), evidence).select("hit", *masks)
    nobody = events.sparkSession.range(1).select(
        F.lit(False).alias("hit"), *[F.lit(0).cast("bigint").alias(m) for m in masks])
    place = f"{dimension.name}_order"
    mask = F.get(F.array(*masks), (F.col("bit") / D.WORD).cast("int"))
    inside = F.getbit(mask, F.col("bit") % D.WORD) == 1
    return (
        profile.unionByName(nobody)
        .select("*", F.posexplode(dimension.label_array()).alias("bit", dimension.name))
        .groupBy("bit", dimension.name)
        .agg(F.count_if(inside).alias(users), F.count_if(inside & F.col("hit")).alias(hits))
        .select(dimension.name, (F.col("bit") + 1).alias(place), users, hits,
                pct_or_zero(F.col(hits), F.col(users)).alias("conversion_rate"))
    )


def weekday_conversion(
    searches: DataFrame, views: DataFrame, reservations: DataFrame
) -> DataFrame:
    """Conversion for each of the seven weekdays, Monday first."""
    return spine_conversion(
        searches, D.DAY_OF_WEEK, full_funnel(views, reservations)).orderBy("day_of_week_order")


def weekday_weekend(by_weekday: DataFrame) -> DataFrame:
    """Mean rate of weekdays and of weekends, and their gap."""
    weekend = F.col("day_of_week").isin(*WEEKEND)
    rate = F.col("conversion_rate")
    return by_weekday.agg(
        F.avg(F.when(~weekend, rate)).alias("weekday_avg"),
        F.avg(F.when(weekend, rate)).alias("weekend_avg"),
        F.avg(rate).alias("avg_rate"),
    ).withColumn("weekday_minus_weekend", F.col("weekday_avg") - F.col("weekend_avg"))


def monthly_conversion(
    searches: DataFrame, views: DataFrame, reservations: DataFrame,
    months: range = D.MONTHS,
) -> DataFrame:
    """Conversion per month that has searchers, each placed against the mean of the months."""
    return against_mean(spine_conversion(
        searches, D.month_dimension(months), full_funnel(views, reservations)))


def against_mean(by_month: DataFrame) -> DataFrame:
    """The months that have searchers, each placed against the mean of their rates."""
    by_month = by_month.where("total_searchers > 0")
    rate = F.col("conversion_rate")
    # One row per month: a window without partitions is safe here.
    return (
        by_month.withColumn("avg_rate", F.avg(rate).over(Window.partitionBy()))
        .withColumn("versus_average",
                    F.when(rate > F.col("avg_rate"), F.lit("above"))
                    .when(rate < F.col("avg_rate"), F.lit("below"))
                    .otherwise(F.lit("equal")))
        .select(F.col("month").cast("int").alias("month"), "total_searchers", "funnel_users",
                "conversion_rate", "avg_rate", "versus_average")
        .orderBy("month")
    )


def host_conversion(searches: DataFrame, views: DataFrame, reservations: DataFrame) -> DataFrame:
    """Hosts against non-hosts with their share of the sum of both groups' searchers."""
    return with_market_share(
        spine_conversion(searches, D.USER_TYPE, full_funnel(views, reservations)))


def with_market_share(by_type: DataFrame) -> DataFrame:
    total = F.sum("total_searchers").over(Window.partitionBy())
    return by_type.withColumn(
        "market_share", pct_or_zero(F.col("total_searchers"), total)
    ).drop("user_type_order")


def host_gap(by_type: DataFrame) -> DataFrame:
    """Host minus non-host rate in points, and relative to the non-host rate."""
    rate = F.col("conversion_rate")
    host, other = HOST_LABELS
    return by_type.agg(
        F.max(F.when(F.col("user_type") == host, rate)).alias("host_rate"),
        F.max(F.when(F.col("user_type") == other, rate)).alias("non_host_rate"),
    ).withColumns({
        "gap_pp": F.col("host_rate") - F.col("non_host_rate"),
        "relative_pct": (F.try_divide(F.col("host_rate"), F.col("non_host_rate")) - F.lit(1.0))
        * F.lit(100.0),
    })


def geography_conversion(
    searches: DataFrame, views: DataFrame, reservations: DataFrame
) -> DataFrame:
    """USA/Canada against international searches."""
    return _two_sided(searches, D.GEOGRAPHY, views, reservations)


def peak_conversion(searches: DataFrame, views: DataFrame, reservations: DataFrame) -> DataFrame:
    """Searches in peak hours against the other hours."""
    return _two_sided(searches, D.PEAK, views, reservations)


def single_dimension(
    searches: DataFrame, views: DataFrame, reservations: DataFrame, dimension: Dimension
) -> DataFrame:
    """Conversion by one dimension without a minimum support, rates rising."""
    return (
        segment_conversion(searches, [dimension], full_funnel(views, reservations),
                           min_users=0, ordered=False)
        .drop("dimension")
        .withColumnRenamed("segment", dimension.name)
        .orderBy("conversion_rate", dimension.name)
    )


def _two_sided(searches, dimension, views, reservations) -> DataFrame:
    return ranked(spine_conversion(searches, dimension, full_funnel(views, reservations),
                                   "total_users", "converting_users"), dimension)


def ranked(by_label: DataFrame, dimension: Dimension) -> DataFrame:
    """The labels of a dimension as characteristics, best rate first."""
    return (
        by_label.drop(f"{dimension.name}_order")
        .withColumnRenamed(dimension.name, "characteristic")
        .orderBy(F.desc("conversion_rate"), "characteristic")
    )


def _mask(dimension: Dimension) -> str:
    return f"mask_{dimension.name}_{dimension.word}"


def _profile(
    events: DataFrame, closed: Sequence[Dimension], evidence: Sequence[DataFrame]
) -> DataFrame:
    """One row per user of ``events``: label masks, number of events and the hit flag.

    Events and evidence meet in one union and one grouping on the user.
    """
    zero = F.lit(0).cast("bigint")
    masks = [_mask(d) for d in closed]
    rows = events.where(F.col(USER).isNotNull()).select(
        F.col(USER).alias(USER_ID), F.lit(0).alias("seen"), F.lit(1).alias("events"),
        *[d.mask().alias(m) for d, m in zip(closed, masks)])
    for i, users in enumerate(evidence):
        rows = rows.unionByName(users.select(
            USER_ID, F.lit(1 << i).alias("seen"), F.lit(0).alias("events"),
            *[zero.alias(m) for m in masks]))
    everywhere = (1 << len(evidence)) - 1
    return (
        rows.groupBy(USER_ID)
        .agg(F.bit_or("seen").alias("seen"), F.sum("events").alias("events"),
             *[F.bit_or(m).alias(m) for m in masks])
        .where("events > 0")
        .select(USER_ID, (F.col("seen") == everywhere).alias("hit"), "events", *masks)
    )


def _minimum(min_users: int | Mapping[str, int]) -> Column:
    if isinstance(min_users, int):
        return F.lit(min_users)
    picked = None
    for name, minimum in min_users.items():
        picked = (F if picked is None else picked).when(
            F.col("dimension") == name, F.lit(minimum))
    return F.lit(0) if picked is None else picked.otherwise(F.lit(0))
