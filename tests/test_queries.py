"""Every query with SQL must give DuckDB's rows, here on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    link = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        link.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return link


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, connection, name):
    result = entry.queries()[name](spark, SF)
    answer = connection.execute(entry.oracle_sql()[name])
    columns = [column[0] for column in answer.description]
    assert sorted(result.columns) == sorted(columns)
    assert check.rows_of(result.columns, result.collect()) == check.rows_of(columns, answer.fetchall())
