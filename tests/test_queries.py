"""Every registered query against its SQL on DuckDB, and no plan with a product of two tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import FLAGSHIP, entry, oracle_sql, queries
from check import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, db, name):
    df = queries()[name](spark, SF)
    rows = rows_of(df.columns, df.collect())
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name in oracle_sql():
        cursor = db.execute(oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows == rows_of(columns, cursor.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert FLAGSHIP in oracle_sql()
    assert entry(spark).count() == 1
