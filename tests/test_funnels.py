from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from stagewise.operators import funnels, journey, ordered
from tests.tables import (
    RESERVATION_SCHEMA,
    SEARCH_SCHEMA,
    START,
    VIEW_SCHEMA,
    make,
    random_rows,
    random_tables,
    reservation,
    search,
    users,
    view,
)

SEEDS = [1, 2]


def tables(spark, searches=(), views=(), reservations=()):
    return (make(spark, SEARCH_SCHEMA, list(searches)), make(spark, VIEW_SCHEMA, list(views)),
            make(spark, RESERVATION_SCHEMA, list(reservations)))


def test_reservers_need_not_have_viewed(spark):
    facts = tables(spark, [search("a"), search("a"), search("b"), search(None)],
                   [view("a"), view("z")],
                   [reservation("b", successful_payment_collected_at=START), reservation("z"),
                    reservation(None)])
    row = funnels.funnel_counts(*facts).first()
    assert (row.total_searchers, row.total_viewers, row.total_reservers, row.total_payers) == (
        2, 1, 1, 1)
    assert (row.search_to_view_rate, row.view_to_reserve_rate, row.overall_rate) == (50, 100, 50)
    assert (row.lost_after_search, row.search_dropoff_pct) == (1, 50)


def test_identity_map_names_renters(spark):
    facts = tables(spark, [search("a")], [], [
        reservation("7"), reservation("7", successful_payment_collected_at=START),
        reservation("a")])
    ids = spark.createDataFrame([("a", "7"), ("a", "7"), (None, "a")],
                                "merged_amplitude_id string, user_id string")
    row = funnels.funnel_counts(*facts, identity_map=ids).first()
    assert (row.total_reservers, row.total_payers) == (1, 1)


def test_empty_tables_give_zeros(spark):
    facts = tables(spark)
    row = funnels.funnel_counts(*facts).first()
    assert (row.total_searchers, row.search_to_view_rate, row.overall_rate) == (0, 0, 0)
    assert funnels.funnel_overlap(*facts).first().search_to_click_rate == 0
    assert funnels.dropoff(*facts).first().click_to_reserve_dropoff_rate == 0
    assert funnels.bot_impact(*facts).first().searcher_change_pct is None
    assert funnels.funnel_by_channel(*facts).count() == 0
    assert ordered.ordered_funnel_summary(ordered.ordered_funnel(*facts)).first().avg_clicks is None


@pytest.mark.parametrize("seed", SEEDS)
def test_overlap_and_dropoff_match_sets(spark, seed):
    searches, views, reservations = random_rows(seed)
    s, c, r = users(searches), users(views[:30]), users(reservations[:30], "renter_user_id")
    facts = tables(spark, searches, views[:30], reservations[:30])
    row = funnels.funnel_overlap(*facts).first()
    assert (row.total_searchers, row.total_clickers, row.total_reservers) == (
        len(s), len(c), len(r))
    assert (row.searched_and_clicked, row.searched_clicked_reserved) == (
        len(s & c), len(s & c & r))
    assert row.searched_clicked_reserved <= row.searched_and_clicked <= row.total_searchers
    lost = funnels.dropoff(*facts).first()
    assert (lost.searched_not_clicked, lost.clicked_not_reserved,
            lost.non_converting_searchers) == (len(s - c), len(c - r), len(s - (s & c & r)))


@pytest.mark.parametrize("seed", SEEDS)
def test_bot_impact_is_the_overlap_twice(spark, seed):
    s, v, r = random_tables(spark, seed, 60)
    row = funnels.bot_impact(s, v, r).first()
    human = funnels.funnel_overlap(s.where("NOT is_bot"), v.where("NOT is_bot"), r).first()
    every = funnels.funnel_overlap(s, v, r).first()
    assert row.all_funnel_users == every.searched_clicked_reserved
    assert row.non_bot_funnel_users == human.searched_clicked_reserved
    assert row.non_bot_clickers == human.total_clickers
    assert row.rate_change_pp == pytest.approx(
        human.search_to_reserve_rate - every.search_to_reserve_rate)


@pytest.mark.parametrize("null_segment", ["drop", "keep"])
def test_channel_funnel_matches_sets(spark, null_segment):
    searches, views, reservations = random_rows(3)
    views, reservations = views[:20], reservations[:20]
    c, r = users(views), users(reservations, "renter_user_id")
    got = {row.channel: row for row in funnels.funnel_by_channel(
        *tables(spark, searches, views, reservations), null_segment=null_segment).collect()}
    channels = {x["first_attribution_channel"] for x in searches}
    assert set(got) == (channels if null_segment == "keep" else channels - {None})
    for channel, row in got.items():
        s = users([x for x in searches if x["first_attribution_channel"] == channel])
        assert (row.total_searchers, row.total_clickers, row.total_reservers) == (
            len(s), len(s & c), len(s & r))
        assert row.searched_clicked_reserved == len(s & c & r)


def test_source_channel_needs_both_parts(spark):
    facts = tables(spark, [
        search("a", first_attribution_source="x", first_attribution_channel="y"),
        search("b", first_attribution_source="x"), search("c", first_attribution_channel="y")])
    assert [r.source_channel for r in funnels.funnel_by_source_channel(*facts).collect()] == [
        "x - y"]
    assert funnels.source_channel_volume(facts[0]).collect() == [("x - y", 1)]


def test_top_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "name string, n int")
    assert [r.name for r in funnels.top(df, 2, "n", "name").collect()] == ["c", "a"]
    assert funnels.with_support(df, "n", 2).count() == 1


def test_bad_null_policy_is_refused(spark):
    with pytest.raises(ValueError):
        funnels.funnel_by_channel(*tables(spark), null_segment="zero")


def test_event_at_the_reservation_time_precedes_it(spark):
    second = timedelta(seconds=1)
    facts = tables(
        spark, [search("a", event_time=START), search("a", event_time=START + second)],
        [view("a", event_time=START), view("b", event_time=START)],
        [reservation("a", reservation_id="r1", listing_id="7"),
         reservation("a", reservation_id="r0", created_at=START - second),
         reservation("b", reservation_id="r2")])
    rows = ordered.ordered_funnel(*facts).collect()
    assert [(r.reservation_id, r.searches, r.clicks, r.listing_id) for r in rows] == [
        ("r1", 1, 1, "7")]


@pytest.mark.parametrize("seed", SEEDS)
def test_history_matches_counting_by_hand(spark, seed):
    searches, views, reservations = random_rows(seed)

    def before(rows, r):
        return sum(x["merged_amplitude_id"] == r["renter_user_id"]
                   and x["event_time"] <= r["created_at"] for x in rows)

    expected = {r["reservation_id"]: (before(searches, r), before(views, r))
                for r in reservations if r["renter_user_id"] is not None}
    got = ordered.reservation_history(*tables(spark, searches, views, reservations)).collect()
    assert {r.reservation_id: (r.searches, r.clicks) for r in got} == expected
    funnel = [v for v in expected.values() if min(v) > 0]
    summary = ordered.ordered_funnel_summary(
        ordered.ordered_funnel(*tables(spark, searches, views, reservations))).first()
    assert summary.reservations == len(funnel)
    assert summary.avg_searches == pytest.approx(sum(v[0] for v in funnel) / len(funnel))


def test_history_sorts_no_raw_events(spark):
    """Windows run over rows that are grouped before, and the grouped instants are made once."""
    df = ordered.reservation_history(*random_tables(spark, 1, 20))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = plan.splitlines()
    windows = [i for i, line in enumerate(lines) if "Window [" in line]
    assert len(windows) == 2
    for i in windows:
        below = "\n".join(lines[i + 1:i + 40])
        assert "HashAggregate" in below.split("Window [")[0].split("Union")[0]
    assert "RangeFrame" not in plan


def test_a_million_events_in_a_minute(spark):
    """A minute of one user is added up per instant before anything is ordered."""
    events = spark.range(1_000_000).select(
        F.lit("a").alias("merged_amplitude_id"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(
            secs=(F.col("id") % 50).cast("decimal(18,6)"))).alias("event_time"))
    views = events.limit(0)
    booked = make(spark, RESERVATION_SCHEMA, [
        reservation("a", reservation_id="x", created_at=START + timedelta(seconds=9)),
        reservation("a", reservation_id="y", created_at=START + timedelta(seconds=60))])
    got = {r.reservation_id: (r.searches, r.clicks)
           for r in ordered.reservation_history(events, views, booked).collect()}
    assert got == {"x": (200_000, 0), "y": (1_000_000, 0)}


def test_journey_counts_without_fan_out(spark):
    searches, views, reservations = random_rows(4)
    ids = [(f"u{i}", f"u{i}") for i in range(15)]
    facts = tables(spark, searches, views, reservations)
    people = spark.createDataFrame(ids, "merged_amplitude_id string, user_id string")
    got = {r.user_id: r for r in journey.user_journey(people, *facts).collect()}
    assert len(got) == len(ids)
    for _, user in ids:
        mine = [x for x in searches if x["merged_amplitude_id"] == user]
        seen = [x for x in views if x["merged_amplitude_id"] == user]
        booked = [x for x in reservations if x["renter_user_id"] == user]
        row = got[user]
        assert row.total_searches == len({x["search_id"] for x in mine} - {None})
        assert row.total_view_events == len({x["event_uuid"] for x in seen})
        assert row.total_reservations == len(booked)
        assert row.has_viewed_listing == int(bool({x["listing_id"] for x in seen} - {None}))
        assert row.first_search_time == min((x["event_time"] for x in mine), default=None)
    totals = journey.funnel_from_journey(journey.user_journey(people, *facts)).first()
    assert totals.total_users == len(ids)
    assert totals.users_who_searched == sum(r.total_searches > 0 for r in got.values())


def test_linkage_counts(spark):
    facts = tables(spark, [search("a"), search("b")], [view("a"), view("a"), view("z")],
                   [reservation("b")])
    got = funnels.linkage_check(*facts).orderBy(F.col("user_id")).collect()
    assert [tuple(r) for r in got] == [("a", 1, 2, 0), ("b", 1, 0, 1)]
