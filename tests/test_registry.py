"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


# the training-data queries have tests of their own beside them
@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    wanted_columns, wanted = rows_of([c[0] for c in result.description], result.fetchall())
    assert columns == wanted_columns
    assert mine == wanted
