"""Every named query against its SQL twin on the smallest data set."""

import __spark_entry__ as entry
import pytest
from conftest import SMALL
from oracle import compare

from starlens import plans

QUERIES, ORACLES = plans.all_queries(), plans.all_oracles()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    difference, _ = compare(df, con, ORACLES[name])
    assert not difference, difference
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan
