"""The registered training-data queries against their SQL twins at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from larder.llm.queries import QUERIES, TWINS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_twin(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    result = db.execute(TWINS[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())
