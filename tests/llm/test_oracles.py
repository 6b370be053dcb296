"""Registered operator queries against SQL, and the shape of all of them."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from tests.conftest import DATA
from turnout.llm.oracles import llm_oracles
from turnout.llm.queries import llm_queries

SF = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_matches_sql(spark, database, name):
    frame = llm_queries()[name](spark, SF)
    cursor = database.execute(llm_oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(c) for c in frame.columns]
    expected = sorted((tuple(row[i] for i in order) for row in cursor.fetchall()), key=str)
    assert sorted(map(tuple, frame.collect()), key=str) == expected


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in llm_queries()] == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]


def test_native_queries_have_no_python(spark):
    for name in ("op2_secrets", "op6_sharding", "op7_exact_dedup"):
        plan = llm_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
