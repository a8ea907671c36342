"""Every registered query against its DuckDB counterpart on the smallest tables."""

import pytest

from checks.compare import compare, duck
from checks.registry import oracle_sql, queries
from conftest import SF


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


BAD = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow")


@pytest.mark.parametrize("name", list(queries()))
def test_same_rows(spark, con, name):
    """The same rows as DuckDB, by a plan without cross joins, nested loops or Python workers."""
    same, text, df = compare(spark, con, SF, name)
    assert same, text
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in BAD if operator in plan]
