"""Induced edges of the asked pairs of tables only: the other pairs are not read."""

from starlens.operators import graph as gr


def test_only_asked_links(spark):
    rows = [(i % 5, i % 3, i % 7, float(i)) for i in range(60)] + [(1, None, 2, 9.0), (None, 1, 3, 8.0)]
    fact = spark.createDataFrame(rows, "item bigint, shop bigint, buyer bigint, v double")
    mapping = {"item": "items", "shop": "shops", "buyer": "buyers"}
    ids = [f"items_{k}" for k in (0, 1, 2)] + ["shops_1", "shops_2"] + [f"buyers_{k}" for k in (2, 3, 6)]
    inside = spark.createDataFrame([(x,) for x in ids], "node_id string")
    for pushed in (1000, 2):
        every = gr.induced_facts(fact, mapping, inside, pushed)
        want = sorted(map(str, every.filter("src_table = 'items' AND dst_table = 'buyers'").collect()))
        some = gr.induced_facts(fact, mapping, inside, pushed, links=[("items", "buyers")])
        assert want and sorted(map(str, some.collect())) == want and some.columns == every.columns
        assert gr.induced_facts(fact, mapping, inside, pushed, links=[]).isEmpty()
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
