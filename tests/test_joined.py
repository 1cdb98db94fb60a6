import pytest
from pyspark.sql import functions as F

from stagewise.operators import dimensions as D
from stagewise.operators import insights, joined, listings, payments, prepare, quality, volume
from tests.tables import (
    RESERVATION_SCHEMA,
    SEARCH_SCHEMA,
    START,
    VIEW_SCHEMA,
    make,
    random_tables,
    reservation,
    search,
    view,
)

SEEDS = [7, 8]


def rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


@pytest.fixture(scope="module", params=SEEDS)
def facts(request, spark):
    return random_tables(spark, request.param, 150)


def distinct(values):
    return len(set(values) - {None})


def mean(values):
    known = [x for x in values if x is not None]
    return None if not known else round(sum(known) / len(known), 2)


def collected(*frames):
    return [[r.asDict() for r in df.collect()] for df in frames]


def as_rows(dicts):
    return sorted((tuple(sorted(d.items())) for d in dicts), key=repr)


def grouped(rows_, *keys):
    out = {}
    for x in rows_:
        out.setdefault(tuple(x[k] for k in keys), []).append(x)
    return out


def pairs_of(searches, views):
    """Every search with each of its views, or with none."""
    return [(x, y) for x in searches for y in
            [y for y in views if x["search_id"] is not None and y["search_id"] == x["search_id"]]
            or [None]]


def performance(searches, views, *keys, averages=False):
    out = []
    for value, mine in grouped(searches, *keys).items():
        both = pairs_of(mine, views)
        users_ = distinct(x["merged_amplitude_id"] for x in mine)
        viewers = distinct(y["merged_amplitude_id"] for _, y in both if y)
        row = dict(zip(keys, value)) | {
            "unique_searchers": users_, "unique_viewers": viewers,
            "total_searches": distinct(x["search_id"] for x in mine),
            "conversion_rate": round(viewers * 100.0 / users_, 2) if users_ else None}
        if averages:
            row |= {"avg_results": mean(x["count_results"] for x, _ in both),
                    "avg_results_unweighted": mean(x["count_results"] for x in mine)}
        out.append(row)
    return as_rows(out)


def close(got, want):
    """Equal up to the last digit of means that fall between two."""
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert [k for k, _ in a] == [k for k, _ in b]
        for (_, x), (_, y) in zip(a, b):
            assert x == (pytest.approx(y, abs=0.011) if isinstance(y, float) else y)


@pytest.mark.parametrize("averages", [True, False])
def test_view_performance_equals_the_join(facts, averages):
    s, v, _ = facts
    got = joined.view_performance(s, v, ["search_type"], averages=averages)
    close(rows(got), performance(*collected(s, v), "search_type", averages=averages))


def test_two_keys_with_nulls_equal_the_join(facts):
    s, v, _ = facts
    keys = ["first_attribution_source", "first_attribution_channel"]
    close(rows(joined.view_performance(s, v, keys)), performance(*collected(s, v), *keys))
    top = joined.attribution_performance(s, v, min_searchers=1, n=2).collect()
    assert len(top) == 2 and top[0].unique_searchers >= top[1].unique_searchers


def test_joined_segments_shuffle_each_side_once(spark, facts, tmp_path):
    s, v, _ = facts
    for name, df in (("s", s), ("v", v)):
        df.write.parquet(f"{tmp_path}/{name}")
    got = joined.search_type_performance(
        spark.read.parquet(f"{tmp_path}/s"), spark.read.parquet(f"{tmp_path}/v"))
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Searches with an id, all searches, views.
    assert plan.count("Scan parquet") == 3
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 8


def test_dma_equals_the_join(facts):
    s, v, r = facts
    searches, views, booked = collected(s, v, r)
    want = []
    for (market,), mine in grouped(searches, "search_dma").items():
        seen = [y for y in views if market is not None and y["click_dma"] == market]
        shown = {y["listing_id"] for y in seen} - {None}
        renting = [b for b in booked if b["listing_id"] in shown]
        want.append({
            "search_dma": market,
            "unique_searchers": distinct(x["merged_amplitude_id"] for x in mine),
            "unique_viewers": distinct(y["merged_amplitude_id"] for y in seen),
            "unique_reservers": distinct(b["renter_user_id"] for b in renting),
            "unique_payers": distinct(b["renter_user_id"] for b in renting
                                      if b["successful_payment_collected_at"])})
    got = joined.dma_performance(s, v, r, min_searchers=0)
    assert rows(got.select(*want[0])) == as_rows(want)
    assert joined.dma_performance(s, v, r, min_searchers=10**6).count() == 0


def test_months_and_hours_equal_the_join(facts):
    s, v, r = facts
    searches, views, booked = collected(s, v, r)
    want = []
    for (month,), mine in grouped(searches, "month").items():
        seen = [y for y in views if month is not None and y["month"] == month]
        renting = [b for b in booked if month is not None and b["created_at"]
                   and b["created_at"].month == month]
        want.append({
            "month": month,
            "unique_searchers": distinct(x["merged_amplitude_id"] for x in mine),
            "unique_viewers": distinct(y["merged_amplitude_id"] for y in seen),
            "unique_reservers": distinct(b["renter_user_id"] for b in renting),
            "unique_payers": distinct(b["renter_user_id"] for b in renting
                                      if b["successful_payment_collected_at"]),
            "total_searches": distinct(x["search_id"] for x in mine),
            "avg_search_results": mean(x["count_results"] for x in mine)})
    close(rows(joined.monthly_trends(s, v, r).drop("search_to_view_rate")), as_rows(want))
    s2, v2 = prepare.clean_searches(s), prepare.clean_views(v)
    searches, views = collected(s2, v2)
    want = [{
        "search_hour": hour,
        "unique_searchers": distinct(x["merged_amplitude_id"] for x in mine),
        "unique_viewers": distinct(y["merged_amplitude_id"] for y in views
                                   if y["view_hour"] == hour),
        "total_searches": distinct(x["search_id"] for x in mine)}
        for (hour,), mine in grouped(searches, "search_hour").items()]
    got = joined.hourly_patterns(s2, v2)
    assert rows(got.drop("conversion_rate")) == as_rows(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_result_categories_come_in_order(spark):
    counts = [0, 1, 10, 11, 50, 51, 200, 201, 1001, None]
    s = make(spark, SEARCH_SCHEMA, [
        search(f"u{i}", search_id=f"s{i}", count_results=n) for i, n in enumerate(counts)])
    got = joined.result_count_performance(
        prepare.clean_searches(s), make(spark, VIEW_SCHEMA, [view("z", search_id="s0")]))
    assert [(r.result_count_category, r.unique_searchers) for r in got.collect()] == [
        ("No Results", 1), ("1-10 Results", 2), ("11-50 Results", 2), ("51-100 Results", 1),
        ("101-200 Results", 1), ("200+ Results", 3)]
    assert got.first().conversion_rate == 100.0


def test_cleaning(spark):
    s = make(spark, SEARCH_SCHEMA, [
        search("a", search_id="1"), search("b"), search(None, search_id="2"),
        search("c", search_id="3", is_bot=True), search("d", search_id="4", is_bot=None),
        search("e", search_id="5", event_time=None)])
    assert [r.search_session_id for r in prepare.clean_searches(s).collect()] == ["a_2024-03-04"]
    v = make(spark, VIEW_SCHEMA, [view("a", listing_id="1", search_position=20), view("b")])
    assert [(r.position_category, r.view_hour) for r in prepare.clean_views(v).collect()] == [
        ("11-20", 0)]
    r = make(spark, RESERVATION_SCHEMA, [
        reservation("a", listing_id="1", approved_at=START.replace(hour=6)), reservation("b")])
    clean = prepare.clean_reservations(r).collect()
    assert [(x.reservation_status, x.hours_to_approval, x.hours_to_payment,
             x.reservation_month) for x in clean] == [("Pending Payment", 6.0, None, 3)]


def test_payments(spark):
    r = make(spark, RESERVATION_SCHEMA, [
        reservation("a"), reservation("b", approved_at=START),
        reservation("c", approved_at=START.replace(hour=3),
                    successful_payment_collected_at=START.replace(hour=9)),
        reservation("d", successful_payment_collected_at=START.replace(hour=1))])
    row = payments.payment_summary(r).first()
    assert tuple(row) == (4, 2, 1, 2, 50.0, 1.5, 5.0)
    assert {x.payment_status: x.share_pct for x in payments.payment_status(r).collect()} == {
        "Successful": 40.0, "Pending": 20.0, "Rejected": 40.0}
    status = payments.lifecycle_status(prepare.clean_reservations(r, required=()))
    assert {x.reservation_status: x.reservations for x in status.collect()} == {
        "Completed": 2, "Pending Payment": 1, "Pending Approval": 1}
    assert [tuple(x) for x in payments.monthly_payments(r).collect()] == [(3, 4, 2, 50.0)]
    assert payments.payment_summary(r.limit(0)).first().payment_completion_rate is None


def test_volumes(spark):
    s = make(spark, SEARCH_SCHEMA, [
        search(u, search_type=t, search_dma=d, month=m, search_term_category=None,
               first_attribution_source="x", first_attribution_channel=t)
        for u, t, d, m in [("a", "map", "d2", 10), ("a", "map", "d1", 2), ("b", "text", None, 2)]])
    assert [tuple(r) for r in volume.search_type_volume(s).collect()] == [
        ("map", 2, 1), ("text", 1, 1)]
    assert [r.month for r in volume.monthly_volume(s).collect()] == [2, 10]
    assert [r.search_dma for r in volume.top_dmas(s, 1).collect()] == ["d1"]
    assert volume.category_volume(s).count() == 0
    assert [r.first_attribution_channel for r in
            volume.top_attribution(s, min_users=1).collect()] == ["map", "text"]




@pytest.mark.parametrize("dimension", [
    D.LISTING_POSITION, D.LISTING_ID_RANGE, D.SOURCE_SCREEN, D.ALREADY_RESERVED, D.HOUR_BIN])
def test_listing_segments_match_counting(spark, dimension):
    _, v, r = random_tables(spark, 9, 200)
    pairs = [tuple(x) for x in v.select(dimension.column(), "listing_id").collect()]
    booked = [x.listing_id for x in r.collect()]
    want = {}
    for segment in {s for s, _ in pairs} - {None}:
        seen = [x for s, x in pairs if s == segment]
        distinct = set(seen) - {None}
        want[segment] = (len(seen), sum(b in distinct for b in booked), len(distinct),
                         len(distinct & set(booked)))
    got = listings.listing_segment_conversion(v, r, [dimension], min_views=1).collect()
    assert {x["segment"]: (x.total_views, x.total_reservations, x.unique_listings,
                           x.reserved_listings) for x in got} == want


def test_all_listing_dimensions_at_once(spark):
    _, v, r = random_tables(spark, 10, 100)
    many = listings.listing_segment_conversion(v, r, min_views=1)
    names = {x["dimension"] for x in many.collect()}
    assert names == {d.name for d in D.listing_dimensions()}
    one = listings.listing_segment_conversion(v, r, [D.HEX_1], min_views=1)
    assert rows(many.where("dimension = 'hex_1'")) == rows(one)


def test_listing_stats(spark):
    v = make(spark, VIEW_SCHEMA, [view("a", listing_id=x) for x in ["1", "1", "2", None]])
    r = make(spark, RESERVATION_SCHEMA, [
        reservation("a", listing_id=x) for x in ["1", "3", "3", None]])
    stats = listings.listing_stats(v, r)
    assert {tuple(x) for x in stats.collect()} == {
        ("1", 2, 1, True, 50.0), ("2", 1, 0, False, 0.0)}
    assert [x.listing_id for x in listings.top_listings(stats, 1).collect()] == ["1", "2"]
    assert [x.listing_id for x in listings.high_volume_listings(stats, 2).collect()] == ["1"]
    row = listings.listing_summary(v, r).first()
    assert tuple(row) == (4, 4, 2, 2, 100.0, 100.0)
    assert listings.listing_summary(v.limit(0), r.limit(0)).first().overall_conversion_rate == 0


def test_quality_checks(spark):
    df = spark.createDataFrame([("True",), ("False",), ("False",), (None,)], "flag string")
    assert [tuple(r) for r in quality.value_counts(df, "flag").collect()] == [
        ("False", 2), (None, 1), ("True", 1)]
    assert quality.value_counts(df, "flag", drop_null=True).count() == 2
    assert quality.distinct_values(df, "flag").count() == 3
    got = quality.filter_counts(df, {"all": F.lit(True), "known": F.col("flag").isNotNull()})
    assert {r.filter_name: r.row_count for r in got.collect()} == {"all": 4, "known": 3}


def test_extremes_break_ties_by_name(spark):
    df = spark.createDataFrame(
        [("search_sort", "b", 5.0), ("search_sort", "a", 5.0), ("search_sort", "d", 1.0),
         ("search_sort", "c", 1.0), ("time", "x", 2.0), ("time", "y", None)],
        "analysis string, characteristic string, conversion_rate double")
    got = {r.analysis: r for r in insights.extremes(df).collect()}
    row = got["search_sort"]
    assert (row.title, row.best, row.worst, row.gap_pp, row.avg_rate) == (
        "SEARCH SORT", "a", "c", 4.0, 3.0)
    assert got["time"].gap_pp == 0
    best = insights.top_characteristics(insights.extremes(df), 1).first()
    assert (best.analysis, best.best_rate) == ("search_sort", 5.0)


def test_tagged_report_is_long(spark):
    a = spark.createDataFrame([("x", None, 1, 2.5)], "k string, j string, n bigint, r double")
    b = spark.createDataFrame([(3,)], "n bigint")
    got = insights.tagged_report({"A": (a, ["k", "j"]), "B": (b, [])}).collect()
    assert {tuple(r) for r in got} == {
        ("A", "x / (none)", "n", 1.0), ("A", "x / (none)", "r", 2.5), ("B", "(all)", "n", 3.0)}
