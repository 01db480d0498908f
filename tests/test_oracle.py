"""Every registered query at the smallest scale: no cross join or Python in its plan, and the rows of
its DuckDB text."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from registry import check
from registry.book import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert word not in plan, word
    result = check.compare(df, con, ORACLES.get(name))
    assert result.startswith("ok") and "TYPES" not in result, result


def test_entry(spark):
    assert entry.entry(spark).count() == 150


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
