from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stagewise.functions import (
    boolean_label,
    bucketize,
    display_label,
    hours_between,
    label_order,
    pct,
    pct_change,
    pct_or_zero,
    peak_label,
    range_label,
    reservation_status,
    search_session_id,
    source_channel,
    weekday_of,
)
from stagewise.functions import buckets as B
from stagewise.functions.buckets import bucket_index
from stagewise.functions.times import WEEKDAYS, minute_index


def column(spark, values, dtype, expression):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_bins_are_open_on_the_left_and_closed_on_the_right(spark):
    values = [0, 1, 10, 11, 50, 51, 100, 101, 200, 201, 1000, 1001, None]
    got = column(spark, values, "int",
                 lambda v: bucketize(v, B.RESULT_COUNT_EDGES, B.RESULT_COUNT_LABELS))
    assert got == [None, "1-10", "1-10", "11-50", "11-50", "51-100", "51-100", "101-200",
                   "101-200", "200+", "200+", None, None]


def test_hour_zero_and_long_terms_have_no_bin(spark):
    assert column(spark, [0, 6, 7, 12, 18, 19, 23], "int",
                  lambda v: bucketize(v, B.HOUR_EDGES, B.HOUR_LABELS)) == [
        None, "Night (0-6)", "Morning (6-12)", "Morning (6-12)", "Afternoon (12-18)",
        "Evening (18-24)", "Evening (18-24)"]
    assert column(spark, ["", "a" * 5, "a" * 6, "a" * 100, "a" * 101], "string",
                  lambda v: bucketize(F.length(v), B.TERM_LENGTH_EDGES, B.TERM_LENGTH_LABELS)
                  ) == [None, "1-5 chars", "6-10 chars", "30+ chars", None]


def test_bins_closed_on_the_left(spark):
    assert column(spark, [0, 1, 2, 3], "int",
                  lambda v: bucketize(v, (0, 1, 3), ("a", "b"), right=False)) == [
        "a", "b", "b", None]


def test_else_label_takes_what_no_bin_holds(spark):
    assert column(spark, [0, 5, None], "int",
                  lambda v: bucketize(v, (0, 1), ("a",), else_label="rest")) == ["rest"] * 3


def test_bucket_index_agrees_with_labels(spark):
    values = [-1, 0, 1, 3, 4, 10, 11, 100, 101, None]
    labels = column(spark, values, "int",
                    lambda v: bucketize(v, B.FREQUENCY_EDGES, B.FREQUENCY_LABELS))
    places = column(spark, values, "int", lambda v: bucket_index(v, B.FREQUENCY_EDGES))
    assert labels == [None if p is None else B.FREQUENCY_LABELS[p] for p in places]


def test_bad_bins_are_refused():
    with pytest.raises(ValueError):
        bucketize(None, (0, 1), ("a", "b"))
    with pytest.raises(ValueError):
        bucketize(None, (1, 0), ("a",))


def test_ranges_send_null_and_outside_to_else(spark):
    assert column(spark, [0, 1, 50, 51, 200, 201, None], "int",
                  lambda v: range_label(v, B.RESULT_COUNT_RANGES, B.RESULT_COUNT_ELSE)) == [
        "No Results", "1-10 Results", "11-50 Results", "51-100 Results", "101-200 Results",
        "200+ Results", "200+ Results"]
    assert column(spark, [0, 1, 5, 6, 20, 21, None], "int",
                  lambda v: range_label(v, B.POSITION_RANGES, B.POSITION_ELSE)) == [
        "20+", "Top 5", "Top 5", "6-10", "11-20", "20+", "20+"]
    assert column(spark, [0, 1, 20, 21, None], "int",
                  lambda v: range_label(v, B.POSITION_BUCKETS)) == [
        None, "Positions 1-5", "Positions 16-20", None, None]


def test_label_order(spark):
    assert column(spark, ["b", "a", "z", None], "string",
                  lambda v: label_order(v, ["a", "b"])) == [2, 1, None, None]


def test_rates(spark):
    row = spark.range(1).select(
        pct(F.lit(1), F.lit(3)), pct(F.lit(1), F.lit(0)), pct_or_zero(F.lit(1), F.lit(4)),
        pct_or_zero(F.lit(1), F.lit(0)), pct_change(F.lit(3), F.lit(4)),
        pct_change(F.lit(3), F.lit(0))).first()
    assert tuple(row) == (33.33, None, 25.0, 0.0, -25.0, None)
    assert dict(spark.range(1).select(pct(F.lit(1), F.lit(3)).alias("r")).dtypes)["r"] == "double"


@pytest.mark.parametrize("dtype", ["timestamp", "timestamp_ntz"])
def test_time_parts(spark, dtype):
    times = [datetime(2024, 3, 4, 8), datetime(2024, 3, 10, 9), datetime(2024, 3, 10, 17, 59),
             datetime(2024, 3, 10, 18), None]
    assert column(spark, times, dtype, weekday_of) == ["Monday", "Sunday", "Sunday", "Sunday", None]
    peak, off = "Peak Hours (9-17)", "Off-Peak Hours"
    assert column(spark, times, dtype, peak_label) == [off, peak, peak, off, None]
    minutes = column(spark, times, dtype, minute_index)
    assert minutes[2] - minutes[1] == 8 * 60 + 59
    later = F.lit(datetime(2024, 3, 10, 18, 30)).cast(dtype)
    assert column(spark, times[3:], dtype, lambda v: hours_between(v, later)) == [0.5, None]


def test_all_weekdays(spark):
    times = [datetime(2024, 3, 4 + i) for i in range(7)]
    assert tuple(column(spark, times, "timestamp_ntz", weekday_of)) == WEEKDAYS


def test_labels(spark):
    time = datetime(2024, 3, 4)
    df = spark.createDataFrame(
        [(None, None), (time, None), (time, time), (None, time)],
        "approved timestamp_ntz, paid timestamp_ntz")
    status = [r[0] for r in df.select(
        reservation_status(F.col("approved"), F.col("paid"))).collect()]
    assert status == ["Pending Approval", "Pending Payment", "Completed", "Completed"]
    row = spark.range(1).select(
        source_channel(F.lit("a"), F.lit("b")), source_channel(F.lit("a"), F.lit(None)),
        search_session_id(F.lit(7), F.lit(time)), display_label(F.lit("search_sort")),
        boolean_label(F.lit(True), ("y", "n")), boolean_label(F.lit(False), ("y", "n")),
        boolean_label(F.lit(None).cast("boolean"), ("y", "n"))).first()
    assert tuple(row) == ("a - b", None, "7_2024-03-04", "SEARCH SORT", "y", "n", None)
