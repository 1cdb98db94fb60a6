"""Every query of the library against its SQL, as the driver checks it."""

import pytest

import __spark_entry__ as entry
from workload.check import connect, differences, sql_rows
from workload.oracles import all_oracles
from workload.queries import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert all_queries().keys() == all_oracles().keys()
    assert all_queries().keys() <= entry.queries().keys()
    assert all_oracles().keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_matches_sql(spark, connection, name):
    df = all_queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert differences(df.columns, rows, *sql_rows(connection, all_oracles()[name])) == ""
