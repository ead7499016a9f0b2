"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def rows(table):
    columns = [table.column(n).to_pylist() for n in sorted(table.column_names)]
    return sorted(zip(*columns), key=repr)


def test_oracles_name_known_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine = QUERIES[name](spark, SF).toArrow()
    theirs = duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
