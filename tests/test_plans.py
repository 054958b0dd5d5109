"""What the physical plans must look like."""

import re

import __spark_entry__ as entry
from conftest import SMALL

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dated_top_n(spark):
    text = plan(QUERIES["e4_top_n_items_month"](spark, SMALL))
    assert "TakeOrderedAndProject" in text
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(o_orderdate", text)
    assert re.search(r"PushedFilters: \[[^]]*LessThan\(o_orderdate", text)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_extendedprice:double>" in text


def test_item_ranking_reads_one_fact_table(spark):
    text = plan(QUERIES["e1_top_n_items_revenue"](spark, SMALL))
    assert "orders.parquet" not in text and "supplier.parquet" not in text
    assert "partial_sum" in text


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["c6_batch_semantic_search"](spark, SMALL))


def test_mean_reuses_the_shuffle(spark):
    df = QUERIES["g1_above_average_ratio"](spark, SMALL)
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_seed_reaches_the_scan(spark):
    from starlens.operators import graph
    from starlens.plans.graph import MAPPING
    from starlens.sources.retail import Retail

    fact = Retail(spark, SMALL).sales(*MAPPING)
    one = spark.createDataFrame([("item_details_1",), ("supplier_details_1",)], "node_id string")
    text = plan(graph.induced_facts(fact, MAPPING, one))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(l_partkey,1\)", text)
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(l_suppkey,1\)", text)
