"""Every registered query with defining SQL, side by side with DuckDB on the smallest tables."""

import os

import pytest

from marquee.plans import all_queries, registry
from tests.oracle import compare, connect

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
NAMES = list(all_queries.load())
SLOW = {"evaluate", "recommend", "semantic_hybrid", "policy_training", "experiment_snapshot"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in NAMES if n in registry.ORACLE])
def test_query_matches_sql(spark, con, name):
    out = registry.QUERIES[name](spark, FOLDER).toPandas()
    assert compare(out, con.sql(registry.ORACLE[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in NAMES if n not in registry.ORACLE and n not in SLOW])
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0
