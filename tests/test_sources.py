import os

import pytest
from pyspark.sql import functions as F

from stagewise.schemas import IDENTITY_MAP, RESERVATIONS, SEARCH_EVENTS, TABLES
from stagewise.sources import catalog, ingest, tables

SEARCH_CSV = '''merged_amplitude_id,search_id,is_bot,is_host,count_results,search_term,event_time,event_date,month
u1,s1,True,0,3,"a, b",2024-01-02 03:04:05,2024-01-02,1
u2,s2,False,1,12.0,,2024-01-02T03:04:05,2024-01-02,1
u3,,0,maybe,x,plain,not a time,,
,s4,1,,,"say ""hi""",2024-01-02 03:04:05,2024-01-02,12
'''
RESERVATION_CSV = """reservation_id,renter_user_id,listing_id,created_at,approved_at,successful_payment_collected_at
r1,u1,7,2024-01-01 00:00:00,2024-01-01 12:00:00,
r2,u2,8,2024-01-01 00:00:00,,
"""


@pytest.fixture
def search_csv(tmp_path):
    path = tmp_path / "searches.csv"
    path.write_text(SEARCH_CSV)
    return str(path)


def test_typed_scan(spark, search_csv):
    df = ingest.read_csv(spark, search_csv, SEARCH_EVENTS)
    assert df.schema == SEARCH_EVENTS
    rows = df.orderBy(F.col("merged_amplitude_id").asc_nulls_last()).collect()
    assert [r.is_bot for r in rows] == [True, False, False, True]
    assert [r.is_host for r in rows] == [False, True, None, None]
    assert [r.count_results for r in rows] == [3, 12, None, None]
    assert [r.search_term for r in rows] == ["a, b", None, "plain", 'say "hi"']
    assert [r.search_id for r in rows] == ["s1", "s2", None, "s4"]
    assert rows[0].event_time == rows[1].event_time and rows[2].event_time is None
    assert [r.month for r in rows] == [1, 1, None, 12]
    assert rows[0].latitude is None


def test_empty_cells_are_not_payments(spark, tmp_path):
    path = tmp_path / "reservations.csv"
    path.write_text(RESERVATION_CSV)
    df = ingest.read_csv(spark, str(path), RESERVATIONS)
    assert df.where("successful_payment_collected_at IS NOT NULL").count() == 0
    assert df.where("approved_at IS NOT NULL").count() == 1


def test_text_scan_keeps_text_and_broken_lines(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("merged_amplitude_id,user_id\na,1\nb,2,3\n")
    text = ingest.read_text_csv(spark, str(path))
    assert [t for _, t in text.dtypes] == ["string"] * 3
    kept = ingest.read_csv(spark, str(path), IDENTITY_MAP, keep_corrupt=True).collect()
    assert {r.merged_amplitude_id: r[ingest.CORRUPT] for r in kept} == {"a": None, "b": "b,2,3"}


def test_normalize_accepts_typed_frames(spark):
    df = spark.createDataFrame([(1, True, 5), (2, None, None)],
                               "merged_amplitude_id bigint, is_bot boolean, count_results bigint")
    out = ingest.normalize(df, SEARCH_EVENTS)
    assert out.schema == SEARCH_EVENTS
    assert [(r.merged_amplitude_id, r.is_bot, r.count_results) for r in out.collect()] == [
        ("1", True, 5), ("2", None, None)]


def test_flags_in_every_spelling(spark):
    df = spark.createDataFrame(
        [("True", 1), ("false", 0), (" 1 ", None), ("0", 1), ("", 0), ("maybe", 2), (None, 0)],
        "is_bot string, is_host int")
    got = ingest.normalize_flags(df, ["is_bot", "is_host", "absent"]).collect()
    assert [r.is_bot for r in got] == [True, False, True, False, None, None, None]
    assert [r.is_host for r in got] == [True, False, None, True, False, None, False]


def test_table_sinks(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.replace_table(spark.range(3), path)
    tables.load_once(spark.range(9), path)
    assert tables.read_table(spark, path).count() == 3
    tables.replace_table(spark.range(9).withColumn("d", F.col("id") % 2), path, ["d"])
    assert tables.read_table(spark, path, where="d = 1", columns=["id"]).count() == 4
    assert os.path.isdir(os.path.join(path, "d=0"))


def test_bucketed_table_groups_without_a_shuffle(spark):
    tables.save_bucketed(spark.range(100), "bucketed_ids", "id", 4)
    plan = spark.table("bucketed_ids").groupBy("id").count()._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[1]
    spark.sql("DROP TABLE bucketed_ids")


def test_catalog(spark):
    tables.register_views({"numbers": spark.range(25), "nothing": spark.range(0)})
    assert {"numbers", "nothing"} <= set(catalog.list_tables(spark))
    assert catalog.describe(spark.table("numbers")) == [("id", "bigint")]
    assert catalog.run_sql(spark, "SELECT * FROM numbers WHERE id < :n", {"n": 4}).count() == 4
    result, error = catalog.try_sql(spark, "SELECT missing FROM numbers")
    assert result is None and "missing" in error
    result, error = catalog.try_sql(spark, "SELECT id FROM numbers")
    assert error is None and catalog.preview(result).count() == 20
    profile = catalog.table_profile({"numbers": spark.range(25), "nothing": spark.range(0)})
    assert {r.table_name: r.row_count for r in profile.collect()} == {"numbers": 25, "nothing": 0}


def test_bundle_is_written_by_name(spark, tmp_path):
    tables.write_bundle({"a": spark.range(1), "b": spark.range(2)}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2


def test_schemas_name_every_source_column():
    assert [len(s.fields) for s in TABLES.values()] == [34, 28, 9, 2]


def test_rejected_cells_are_listed(spark, tmp_path):
    path = tmp_path / "searches.csv"
    path.write_text(SEARCH_CSV + "u5,s5,2,False,1.5,x,2024-01-02 00:00:00,soon,13.0\nu6,s6,0\n")
    typed, rejected = ingest.read_checked_csv(spark, str(path), SEARCH_EVENTS, "merged_amplitude_id")
    assert typed.schema == SEARCH_EVENTS and typed.count() == 6
    assert {tuple(r) for r in rejected.collect()} == {
        ("u3", "is_host", "maybe", "not a flag"),
        ("u3", "count_results", "x", "not a whole number"),
        ("u3", "event_time", "not a time", "not a time"),
        ("u5", "is_bot", "2", "not a flag"),
        ("u5", "count_results", "1.5", "not a whole number"),
        ("u5", "event_date", "soon", "not a date"),
        ("u6", ingest.CORRUPT, "u6,s6,0", "wrong number of cells")}
    # Only what the typed table lost is listed, whatever the types of the source.
    numbers = spark.createDataFrame([("a", 2), ("b", 1), ("c", None)], "event_uuid string, is_bot int")
    assert [tuple(r) for r in ingest.rejects(numbers, SEARCH_EVENTS, "event_uuid").collect()] == [
        ("a", "is_bot", "2", "not a flag")]
    assert ingest.rejects(numbers.limit(0), SEARCH_EVENTS, "event_uuid").collect() == []


def test_lines_of_text_are_parsed_like_files(spark):
    lines = spark.createDataFrame([('u1,"a, ""b""",',), ("u2,x",), ("u3,x,y,z",), (None,)], "value string")
    got = ingest.parse_lines(lines, ["u", "t", "e"]).collect()
    assert [(r.u, r.t, r.e) for r in got[:1]] == [("u1", 'a, "b"', None)]
    assert [r[ingest.CORRUPT] for r in got[:3]] == [None, "u2,x", "u3,x,y,z"]


def failing(df):
    return df.select(F.assert_true(F.col("id") < 0).alias("x"))


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.replace_table(spark.range(3), path)
    with pytest.raises(Exception):
        tables.replace_table(failing(spark.range(9)), path)
    assert tables.read_table(spark, path).count() == 3
    assert [p for p in os.listdir(tmp_path) if not p.startswith(".")] == ["table"]


def test_a_table_may_replace_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.replace_table(spark.range(6), path)
    tables.replace_table(tables.read_table(spark, path, where="id % 2 = 0"), path)
    assert sorted(r.id for r in tables.read_table(spark, path).collect()) == [0, 2, 4]


def test_a_half_loaded_table_is_loaded_again(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(Exception):
        tables.load_once(failing(spark.range(9)), path)
    spark.range(2).write.parquet(path)
    os.remove(os.path.join(path, tables.MARKER))
    assert not tables.is_complete(spark, path)
    assert tables.load_once(spark.range(5), path)
    assert not tables.load_once(spark.range(9), path)
    assert tables.read_table(spark, path).count() == 5


def test_a_switch_that_was_cut_off_is_undone(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.replace_table(spark.range(4), path)
    tables._rename(tables._folder(spark, path)[0], spark, path, path + tables.REPLACED)
    assert not tables.load_once(spark.range(9), path)
    assert tables.read_table(spark, path).count() == 4
