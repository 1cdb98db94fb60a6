from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stagewise.operators import dimensions as D
from stagewise.operators import position, segments
from stagewise.operators.dimensions import Dimension
from stagewise.operators.users import renters, user_ids
from tests.tables import (
    RESERVATION_SCHEMA,
    SEARCH_SCHEMA,
    START,
    VIEW_SCHEMA,
    make,
    random_rows,
    random_tables,
    search,
    users,
    view,
)


def by_segment(df):
    return {(r["dimension"], r["segment"]): tuple(r)[2:] for r in df.collect()}


def expected(rows, value, hits, minimum=1):
    out = {}
    for segment in {value(r) for r in rows} - {None}:
        people = users([r for r in rows if value(r) == segment])
        if len(people) >= minimum:
            out[segment] = (len(people), len(people & hits))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = random_rows(5)
    rows = rows[0], rows[1][:20], rows[2][:20]
    frames = tuple(make(spark, schema, part) for schema, part in
                   zip((SEARCH_SCHEMA, VIEW_SCHEMA, RESERVATION_SCHEMA), rows))
    return rows, frames


def as_open(dimension: Dimension) -> Dimension:
    return Dimension(dimension.name, dimension.column)


def test_closed_and_open_forms_agree(data):
    _, (s, v, r) = data
    closed = [d for d in D.search_dimensions() if d.closed]
    evidence = segments.full_funnel(v, r)
    one = segments.segment_conversion(s, closed, evidence, min_users=0)
    other = segments.segment_conversion(s, [as_open(d) for d in closed], evidence, min_users=0)
    assert by_segment(one) == by_segment(other)


def test_open_dimensions_can_be_closed_over_their_values(data):
    _, (s, v, r) = data
    dims, evidence = D.search_dimensions(), segments.full_funnel(v, r)
    closed = D.close_dimensions(s, dims)
    assert [d.name for d in closed] == [d.name for d in dims] and all(d.closed for d in closed)
    assert by_segment(segments.segment_conversion(s, closed, evidence, min_users=0)) == \
        by_segment(segments.segment_conversion(s, dims, evidence, min_users=0))
    assert not any(d.closed for d in D.close_dimensions(s, [D.SEARCH_TYPE], max_labels=1))
    assert not any(d.closed for d in D.close_dimensions(s.limit(0), [D.SEARCH_TYPE]))


def test_segments_match_sets(data):
    (searches, views, reservations), facts = data
    hits = users(views) & users(reservations, "renter_user_id")
    got = by_segment(segments.search_characteristics(*facts, min_users=0))
    weekday = ("Monday Tuesday Wednesday Thursday Friday Saturday Sunday").split()
    readers = {
        "search_type": lambda x: x["search_type"],
        "month": lambda x: None if x["month"] is None else str(x["month"]),
        "host": lambda x: None if x["is_host"] is None else str(x["is_host"]).lower(),
        "day_of_week": lambda x: weekday[x["event_time"].weekday()],
        "result_count": lambda x: {1: "1-10", 10: "1-10", 11: "11-50", 200: "101-200",
                                   1000: "200+"}.get(x["count_results"]),
        "term_length": lambda x: {1: "1-5 chars", 9: "6-10 chars"}.get(len(x["search_term"])),
    }
    for name, reader in readers.items():
        mine = {k[1]: v[:2] for k, v in got.items() if k[0] == name}
        assert mine == expected(searches, reader, hits), name
    assert all(total >= hit and rate == hit / total * 100 for total, hit, rate in got.values())


def test_metrics_are_complements(data):
    (searches, views, _), (s, v, r) = data
    dims, evidence = [D.SEARCH_TYPE, D.HOST], segments.full_funnel(v, r)
    yes = by_segment(segments.segment_conversion(s, dims, evidence, min_users=0))
    no = by_segment(segments.segment_conversion(s, dims, evidence, "non_converting", 0))
    assert yes.keys() == no.keys()
    assert all(yes[k][0] == no[k][0] == yes[k][1] + no[k][1] for k in yes)
    never = by_segment(segments.never_clicked(s, v, min_users=0))
    clickers = users(views)
    for (name, segment), (total, count, _) in never.items():
        people = users([x for x in searches if x[name] == segment])
        assert (total, count) == (len(people), len(people - clickers))


def test_minimum_support_per_dimension(data):
    _, (s, v, r) = data
    got = by_segment(segments.segment_conversion(
        s, [D.SEARCH_TYPE, D.SEARCH_SORT, D.HOST], segments.full_funnel(v, r),
        min_users={"search_type": 0, "search_sort": 10**6, "host": 0}))
    assert {name for name, _ in got} == {"search_type", "host"}


def test_null_segment_can_be_kept(data):
    (searches, *_), (s, v, r) = data
    got = by_segment(segments.segment_conversion(
        s, [D.SEARCH_TYPE, D.HOST], segments.full_funnel(v, r), min_users=0,
        null_segment="keep"))
    nobody = users([x for x in searches if x["search_type"] is None])
    assert got["search_type", None][0] == len(nobody)
    assert ("host", None) in got


def test_search_frequency_bins(spark):
    counts = {"a": 1, "b": 3, "c": 4, "d": 10, "e": 11, "f": 100, "g": 101}
    s = make(spark, SEARCH_SCHEMA, [search(u) for u, n in counts.items() for _ in range(n)])
    got = by_segment(segments.segment_conversion(
        s, [], [user_ids(s.where("merged_amplitude_id IN ('a', 'c')"))], min_users=0,
        frequency=True))
    assert {k[1]: v[:2] for k, v in got.items()} == {
        "1 search": (1, 1), "2-3 searches": (1, 0), "4-10 searches": (2, 1),
        "10+ searches": (2, 0)}


def test_top_terms_break_ties_by_name(spark):
    s = make(spark, SEARCH_SCHEMA, [search(u, search_term=t) for t in "cab" for u in "xyz"])
    v, r = make(spark, VIEW_SCHEMA, [view("x")]), make(spark, RESERVATION_SCHEMA, [])
    got = segments.search_terms(s, v, r, min_users=3, n=2).collect()
    assert [x["segment"] for x in got] == ["a", "b"]


def test_weekdays_are_all_there_even_without_data(spark):
    facts = (make(spark, SEARCH_SCHEMA, []), make(spark, VIEW_SCHEMA, []),
             make(spark, RESERVATION_SCHEMA, []))
    rows = segments.weekday_conversion(*facts).collect()
    assert [r.day_of_week_order for r in rows] == list(range(1, 8))
    assert {(r.total_searchers, r.conversion_rate) for r in rows} == {(0, 0.0)}
    assert segments.monthly_conversion(*facts).count() == 0
    gap = segments.host_gap(segments.host_conversion(*facts)).first()
    assert gap.relative_pct is None


def test_weekday_weekend_means(data):
    _, facts = data
    rows = segments.weekday_conversion(*facts)
    rates = [r.conversion_rate for r in rows.collect()]
    row = segments.weekday_weekend(rows).first()
    assert row.weekday_avg == pytest.approx(sum(rates[:5]) / 5)
    assert row.weekend_avg == pytest.approx(sum(rates[5:]) / 2)


def test_months_against_their_mean(data):
    _, facts = data
    rows = segments.monthly_conversion(*facts).collect()
    assert [r.month for r in rows] == [1, 2, 3]
    mean = sum(r.conversion_rate for r in rows) / 3
    for r in rows:
        assert r.avg_rate == pytest.approx(mean)
        assert (r.versus_average == "above") == (r.conversion_rate > r.avg_rate)


def test_two_sided_analyses_overlap(data):
    (searches, views, reservations), facts = data
    hits = users(views) & users(reservations, "renter_user_id")
    hosts = {r.user_type: r for r in segments.host_conversion(*facts).collect()}
    people = users([x for x in searches if x["is_host"]])
    assert (hosts["Hosts"].total_searchers, hosts["Hosts"].funnel_users) == (
        len(people), len(people & hits))
    assert sum(r.market_share for r in hosts.values()) == pytest.approx(100)
    peak = {r.characteristic: r.total_users for r in segments.peak_conversion(*facts).collect()}
    assert peak["Peak Hours (9-17)"] == len(
        users([x for x in searches if 9 <= x["event_time"].hour <= 17]))
    geo = {r.characteristic: r.total_users
           for r in segments.geography_conversion(*facts).collect()}
    assert geo["International"] == len(
        users([x for x in searches if x["is_usa_canada"] is False]))


def test_positions_match_sets(data):
    (searches, views, reservations), (s, v, r) = data
    booked = users(reservations, "renter_user_id")
    rows = position.position_conversion(v, r).collect()
    assert [x.search_position for x in rows] == list(range(1, 21))
    for x in rows:
        people = users([y for y in views if y["search_position"] == x.search_position])
        assert (x.total_clickers, x.funnel_users) == (len(people), len(people & booked))
    ten = position.position_funnel(s, v, r).collect()
    assert len(ten) == 10 and {"Position 1", "Position 10"} <= {x.characteristic for x in ten}


def test_position_buckets(data):
    (_, views, reservations), (_, v, r) = data
    approved = [x for x in reservations if x["approved_at"] is not None]
    booked = users(approved, "renter_user_id")
    ranges = [(1, 5), (6, 10), (11, 15), (16, 20)]
    rows = position.bucket_conversion(v, r.where("approved_at IS NOT NULL")).collect()
    estimated = {x.position_bucket: x for x in position.estimated_bucket_conversion(
        v, r.where("approved_at IS NOT NULL")).collect()}
    both = len(users(views) & booked)
    for row, (low, high) in zip(rows, ranges):
        inside = [x for x in views if low <= (x["search_position"] or 0) <= high]
        people = users(inside)
        assert (row.total_clickers, row.converting_users) == (len(people), len(people & booked))
        guess = estimated[row.position_bucket]
        assert guess.total_clickers == len(people)
        assert guess.click_proportion == len(inside) / len(views)
        assert guess.estimated_converting_users == int(both * (len(inside) / len(views)))


def test_click_shares_never_fall_and_end_below_100(spark):
    _, v, _ = random_tables(spark, 6)
    rows = position.click_distribution(v).collect()
    shares = [r.cumulative_percentage for r in rows]
    assert len(rows) == 20 and shares == sorted(shares) and shares[-1] < 100
    assert sum(r.total_clicks for r in rows) == v.where(
        F.col("search_position").between(1, 20)).count()
    empty = position.click_distribution(v.limit(0)).collect()
    assert {(r.total_clicks, r.click_percentage) for r in empty} == {(0, 0.0)}


def test_position_decline(spark):
    df = spark.createDataFrame([(1, 5, 10.0), (2, 0, 0.0), (6, 3, 4.0)],
                               "search_position int, n int, rate double")
    row = position.position_insights(df, "rate", "n").first()
    assert (row.top_avg, row.rest_avg, row.avg_rate) == (10, 4, 7)
    assert (row.decline, row.decline_per_step) == (6, 1.2)


def test_sort_conversion(spark):
    s = make(spark, SEARCH_SCHEMA, [
        search("a", search_sort="price", count_results=4), search("a", search_sort="price"),
        search("b", search_sort="price", count_results=2), search("b", search_sort="near"),
        search("c"), search(None, search_sort="near")])
    v = make(spark, VIEW_SCHEMA, [view("a"), view("a", is_bot=True), view("c"), view("z")])
    got = {r.search_sort: r for r in position.sort_conversion(s, v).collect()}
    price, near = got["price"], got["near"]
    assert (price.total_users, price.converting_users, price.total_searches) == (2, 1, 3)
    assert (price.avg_results, price.avg_searches_per_user) == (3.0, 1.5)
    assert (near.total_users, near.converting_users, near.total_searches) == (1, 0, 2)
    assert price.overall_rate == near.overall_rate == 50.0


def test_dimension_definitions_are_checked():
    with pytest.raises(ValueError):
        Dimension("x")
    with pytest.raises(ValueError):
        Dimension("x", labels=("a",))
    with pytest.raises(ValueError):
        D.number_dimension("x", range(0, 10, 2))
    with pytest.raises(ValueError):
        segments.segment_conversion(None, [], [], metric="other")


def test_more_labels_than_one_mask_holds(spark):
    wide = D.number_dimension("count_results", range(0, 150))
    rows = [search(f"u{i % 7}", count_results=i) for i in range(0, 160, 3)]
    got = by_segment(segments.segment_conversion(
        make(spark, SEARCH_SCHEMA, rows), [wide], [spark.createDataFrame([("u0",)], "user_id string")],
        min_users=0))
    assert got.keys() == {("count_results", str(i)) for i in range(0, 150, 3)}
    assert all(v[1] == (int(k[1]) % 7 == 0) for k, v in got.items())


def test_values_outside_a_closed_list_are_kept(spark):
    old = make(spark, SEARCH_SCHEMA, [search("a", search_sort="price"), search("b")])
    closed = D.close_dimensions(old, [D.SEARCH_SORT])
    assert closed[0].closed
    new = make(spark, SEARCH_SCHEMA, [search("a", search_sort="price"), search("b", search_sort="near")])
    got = by_segment(segments.segment_conversion(
        new, closed, [user_ids(new)], min_users=0))
    assert got.keys() == {("search_sort", "price"), ("search_sort", "near")}


def test_options_that_name_nothing(spark):
    rows = make(spark, SEARCH_SCHEMA, [search("a", search_sort="price", search_type="map")])
    dims = [D.SEARCH_SORT, D.SEARCH_TYPE]
    for wrong in ({"null_segment": "kept"}, {"min_users": {"search_srt": 2}}, {"metric": "x"}):
        with pytest.raises(ValueError):
            segments.segment_conversion(rows, dims, [user_ids(rows)], **wrong)
    # A dimension that is not named has no minimum.
    got = by_segment(segments.segment_conversion(
        rows, dims, [user_ids(rows)], min_users={"search_sort": 2}))
    assert got.keys() == {("search_type", "map")}


def test_a_user_with_a_third_of_all_rows(spark):
    """The result is that of the sets, whatever one user's share of the rows."""
    start = datetime(2024, 3, 4)
    rows = [search("hot" if i % 3 == 0 else f"u{i}", search_term=f"t{i % 500}",
                   event_time=start + timedelta(minutes=i)) for i in range(3000)]
    s = make(spark, SEARCH_SCHEMA, rows)
    hits = [user_ids(s.where("merged_amplitude_id = 'hot'"))]
    got = by_segment(segments.segment_conversion(
        s, [D.SEARCH_TERM, D.DAY_OF_WEEK], hits, min_users=0))
    want = expected(rows, lambda x: x["search_term"], {"hot"})
    assert {k[1]: v[:2] for k, v in got.items() if k[0] == "search_term"} == want


def test_renters_are_users(spark):
    r = make(spark, RESERVATION_SCHEMA, [{"renter_user_id": "a"}, {"renter_user_id": None}])
    assert [x.user_id for x in renters(r).collect()] == ["a"]
    assert START.weekday() == 0
