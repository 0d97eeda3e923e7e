"""Every query of the subpackage that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from readwindows.llm.queries import ORACLES, QUERIES
from helpers import compare

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    compare(QUERIES[name](spark, SF_DIR), duck.execute(ORACLES[name]))
