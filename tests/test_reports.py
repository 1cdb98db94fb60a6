import os
import re

import pytest
from pyspark.sql import functions as F

from stagewise.operators import dimensions as D
from stagewise.operators import funnels, identity, listings, position, segments, volume
from stagewise.plans import reports
from stagewise.plans.sharing import Store
from stagewise.schemas import IDENTITY_MAP
from stagewise.sources.tables import write_bundle
from tests.tables import random_tables

REPORTS = [
    (reports.funnel_report, "user_journey"), (reports.performance_report, "categories"),
    (reports.cleaned_report, "tagged"), (reports.characteristics_report, "top_terms"),
    (reports.non_converting_report, "never_clicked_by_type"),
    (reports.listing_report, "summary"), (reports.chart_tables, "clicks"),
    (reports.insight_report, "opportunities"),
]


@pytest.fixture(scope="module")
def tables(spark):
    s, v, r = random_tables(spark, 11, 80)
    ids = spark.createDataFrame([(f"u{i}", f"u{i}") for i in range(12)], IDENTITY_MAP)
    return reports.Tables.of({"search_events": s, "listing_views": v, "reservations": r,
                              "amplitude_user_ids": ids})


@pytest.mark.parametrize("report, member", REPORTS)
def test_every_result_of_a_bundle_computes(tables, report, member):
    bundle = report(tables)
    assert member in bundle
    assert all(df.collect() is not None for df in bundle.values())


def test_bundle_cut_by_dimension(tables, tmp_path):
    bundle = reports.characteristics_report(tables, min_users=1)
    assert bundle["search_type"].count() == 2
    assert "dimension" not in bundle["search_type"].columns
    write_bundle({"search_type": bundle["search_type"]}, str(tmp_path))


def test_shared_frame_reads_the_checkpoint(spark):
    store = Store()
    shared = store.share(spark.range(5).selectExpr("id * 2 AS x"))
    assert "Range" not in shared._jdf.queryExecution().toString()
    assert sorted(r.x for r in shared.collect()) == [0, 2, 4, 6, 8]


def scans(df) -> list[str]:
    """The folders that the final plan of a computed frame reads."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sorted(re.findall(r"Location: InMemoryFileIndex.*?/facts/(\w+)\]", plan))


@pytest.fixture(scope="module")
def stored_facts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data") / "facts"
    frames = []
    for name, df in zip(("searches", "views", "reservations"), random_tables(spark, 12, 200)):
        df.write.parquet(f"{folder}/{name}")
        frames.append(spark.read.parquet(f"{folder}/{name}"))
    return reports.Tables(*frames)


def test_a_population_reads_each_fact_once(stored_facts):
    once = ["reservations", "searches", "views"]
    assert scans(reports.searcher_population(stored_facts)) == once
    assert scans(reports.clicker_population(stored_facts)) == once
    s, v, r = stored_facts.facts()
    assert scans(segments.search_characteristics(s, v, r, min_users=0)) == once
    assert scans(segments.non_converting_searches(s, v, r, min_users=0)) == once
    assert scans(position.sort_conversion(s, v)) == ["searches", "views"]
    assert scans(listings.listing_segment_conversion(v, r, min_views=0)).count("views") == 2


def test_charts_are_cut_from_what_is_shared(spark, stored_facts):
    bundle = reports.chart_tables(stored_facts)
    rescanning = {name for name, df in bundle.items() if scans(df)}
    assert rescanning == {
        "payment_status", "position_buckets_estimated", "clicks", "sort_activity"}
    humans = stored_facts.without_bots().facts()
    for name, one in (("weekday", segments.weekday_conversion(*humans)),
                      ("monthly", segments.monthly_conversion(*humans)),
                      ("hosts", segments.host_conversion(*humans)),
                      ("sort", segments.single_dimension(*humans, D.SEARCH_SORT)),
                      ("geography", segments.geography_conversion(*humans)),
                      ("funnel", funnels.funnel_counts(*humans)),
                      ("position", position.position_conversion(*humans[1:])),
                      ("monthly_volume", volume.monthly_volume(humans[0])),
                      ("top_attribution", volume.top_attribution(humans[0]))):
        assert bundle[name].columns == one.columns
        assert bundle[name].collect() == one.collect()
    folder = spark.conf.get("spark.checkpoint.dir")
    before = len(os.listdir(folder))
    bundle.release()
    assert len(os.listdir(folder)) == before - 3
    with pytest.raises(Exception):
        bundle["weekday"].limit(1).collect()


def test_bundles_resolve_renters_once(spark):
    s, v, r = random_tables(spark, 13, 120)
    accounts = r.withColumn("renter_user_id", F.concat(F.lit("account-"), "renter_user_id"))
    pairs = [(f"u{i}", f"account-u{i}") for i in range(12)]
    linked = reports.Tables(s, v, accounts, spark.createDataFrame(pairs, IDENTITY_MAP))
    plain = reports.Tables(s, v, r)
    for report, names in ((reports.chart_tables, ("funnel", "weekday", "position")),
                          (reports.characteristics_report, ("search_type",)),
                          (reports.performance_report, ("monthly", "geographic"))):
        one, other = report(linked), report(plain)
        for name in names:
            assert one[name].collect() == other[name].collect()


def test_identity_maps(spark):
    booked = spark.createDataFrame(
        [("r1", "a1"), ("r2", "a2"), ("r3", "b"), ("r4", "x"), ("r5", None)],
        "reservation_id string, renter_user_id string")
    pairs = spark.createDataFrame(
        [("u", "a1"), ("u", "a2"), ("v", "b"), ("w", "b"), ("w", "b"), (None, "x"), ("y", None)],
        "merged_amplitude_id string, user_id string")

    def of(**options):
        df = identity.resolve_renters(booked, pairs, **options)
        assert df.columns == booked.columns
        return sorted(map(tuple, df.collect()), key=repr)

    assert of() == [("r1", "u"), ("r2", "u"), ("r3", "v"), ("r3", "w")]
    assert of(shared="least") == [("r1", "u"), ("r2", "u"), ("r3", "v")]
    assert of(shared="least", unmatched="keep") == [
        ("r1", "u"), ("r2", "u"), ("r3", "v"), ("r4", None), ("r5", None)]
    assert [tuple(x) for x in identity.unmatched_renters(booked, pairs).collect()] == [("x", 1)]
    for wrong in ({"shared": "some"}, {"unmatched": "raise"}):
        with pytest.raises(ValueError):
            identity.resolve_renters(booked, pairs, **wrong)
