"""Rows with nulls where the shipped tables have none."""

from starlens.functions.questions import first_number, ranked_limit
from starlens.functions.stats import global_rank
from starlens.operators.search import semantic_search


def test_nulls_rank_last_and_stay(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0), (4, None)], "i int, v double")
    got = {r.i: r.r for r in global_rank(df, "v", "r").collect()}
    assert got == {3: 1, 1: 2, 2: 3, 4: 3}


def test_nodes_without_a_fitting_embedding_are_no_candidates(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [-1.0, 0.0]), (4, [1.0])]
    nodes = spark.createDataFrame(rows, "node_id int, embedding array<double>")
    assert [r.node_id for r in semantic_search(nodes, [1.0, 0.0], 3).collect()] == [1, 3]


def test_whole_numbers_as_limits(spark):
    q = spark.createDataFrame([("top 12345678901234567890 items",), ("top 7",), (None,)], "q string")
    got = [tuple(r) for r in q.select(first_number("q"), ranked_limit("q")).collect()]
    assert got == [(None, None), (7, 7), (5, 5)]
