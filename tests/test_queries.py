"""The registered queries outside the training-data subpackage against their plain SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from readwindows.checks.oracles import ORACLES
from readwindows.checks.queries import QUERIES
from helpers import compare

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "orders"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    compare(QUERIES[name](spark, SF_DIR), duck.execute(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_model_query_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    rows = {(r.chromosome, r.labels): r.windows for r in entry_point.entry(spark).collect()}
    assert rows == {("chr1", 0): 3531, ("chr1", 1): 25}


def test_all_queries_are_registered():
    assert QUERIES.keys() <= entry_point.queries().keys() and ORACLES.keys() <= entry_point.oracle_sql().keys()
