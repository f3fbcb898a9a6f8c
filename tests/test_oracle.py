"""Every registered query with a DuckDB twin matches it (row count, column
names, order-insensitive values) on the driver's sf0.001 tables."""

import pytest

import os, sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as E
from oracle_compare import compare, duck

from conftest import SF_SMALL

from strideframe.plans import ORACLE, QUERIES

SQL = {k: v for k, v in ORACLE.items() if k in QUERIES}
FAST = [n for n in QUERIES if n in SQL and not n.startswith("stream_")]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF_SMALL, name, E.queries()[name], SQL[name], con)
    assert r["status"] == "match", r


def test_every_query_has_a_callable():
    assert set(QUERIES) <= set(E.queries())
    assert set(SQL) <= set(QUERIES)
    rows_only = set(QUERIES) - set(SQL)
    assert rows_only == {"tree_scores", "score_requests", "stream_scores", "model_accuracy"}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["part", "goal", "predicted_goal", "n"]
    assert sum(r["n"] for r in rows) == 1000
