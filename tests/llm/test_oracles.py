"""The corpus queries against their SQL."""

import pytest
from conftest import SMALL
from oracle import compare

from starlens.llm import queries


@pytest.mark.parametrize("name", queries.all_oracles())
def test_same_as_sql(spark, con, name):
    difference, _ = compare(queries.all_queries()[name](spark, SMALL), con, queries.all_oracles()[name])
    assert not difference, difference


def test_native_queries_run_no_python(spark):
    for name in ("op1_pii_surrogates", "op6_secret_scan", "op8_quality_rules"):
        plan = queries.all_queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan
