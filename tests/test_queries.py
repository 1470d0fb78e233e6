"""Every registered query against its checking SQL."""

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry_points
from fieldsift.queries.registry import CHECKS, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def test_every_query_has_checking_sql():
    assert set(CHECKS) == set(QUERIES)


def test_entry_points_hold_the_registered_queries():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(CHECKS) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 200


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    frame = QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    result = database.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    assert got and got == expected
