"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from oracle_queries import all_oracles
from tests.conftest import DATA
from turnout.plans.catalogue import all_queries

SF = f"{DATA}/sf0.01"
QUERIES = all_queries()
ORACLES = all_oracles()
SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _sorted(records, columns):
    tuples = [tuple(record[c] for c in columns) for record in records]
    return sorted(tuples, key=lambda row: tuple((value is None, str(value)) for value in row))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, database, name):
    frame = QUERIES[name](spark, SF)
    cursor = database.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = [dict(zip(names, row)) for row in cursor.fetchall()]
    assert sorted(frame.columns) == sorted(names)
    assert {c: SQL_TYPES[t] for c, t in frame.dtypes} == types
    columns = sorted(names)
    assert _sorted(frame.collect(), columns) == _sorted(expected, columns)


def test_entry(spark):
    frame = entry_point.entry(spark)
    assert frame.columns == ["year", "quarter", "label", "newcomers", "returning"]
    assert frame.count() > 0
