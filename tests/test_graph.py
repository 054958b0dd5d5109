"""The worked example: two customers, two products, three sales."""

import pytest

from starlens.operators import graph as gr
from starlens.sources import graph_store
from starlens.operators.evaluate import result_diff

MAPPING = {"customer_id": "Customer", "product_id": "Product"}


@pytest.fixture(scope="module")
def star(spark):
    customers = spark.createDataFrame(
        [("C1", "Acme Corp", "Enterprise", "West"), ("C2", "Tech Inc", "SMB", "East")],
        "customer_id string, name string, segment string, region string",
    )
    products = spark.createDataFrame(
        [("P1", "Widget", "Hardware"), ("P2", "Gadget", None)], "product_id string, name string, category string"
    )
    sales = spark.createDataFrame(
        [("S1", "C1", "P1", 999.90, 10), ("S2", "C1", "P2", 249.95, 5), ("S3", "C2", "P1", 499.95, 5)],
        "sale_id string, customer_id string, product_id string, revenue double, quantity int",
    )
    return customers, products, sales


def ids(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_nodes_and_texts(star):
    customers, products, _ = star
    nodes = gr.build_nodes({"Customer": customers, "Product": products})
    texts = dict(ids(nodes, "node_id", "node_text"))
    assert len(texts) == 4
    assert texts["Customer_C1"] == "customer_id: C1 | name: Acme Corp | segment: Enterprise | region: West"
    assert texts["Product_P2"] == "product_id: P2 | name: Gadget"


def test_edges_and_walk(spark, star):
    _, _, sales = star
    edges = gr.build_edges(sales, MAPPING)
    assert edges.count() == 3
    adj = gr.adjacency(edges)
    assert ids(adj, *adj.columns) == ids(gr.adjacency_of(sales, MAPPING), *adj.columns)
    seeds = spark.createDataFrame([("Customer_C1",), ("Nowhere_1",)], "node_id string")
    one = ids(gr.expand_context(adj, seeds, 1), "node_id", "hop")
    assert one == {("Customer_C1", 0), ("Nowhere_1", 0), ("Product_P1", 1), ("Product_P2", 1)}
    two = ids(gr.expand_context(adj, seeds, 2), "node_id", "hop")
    assert two == one | {("Customer_C2", 2)}
    far = ids(gr.expand_context(adj, seeds, 6), "node_id", "hop")
    assert far == two


def test_long_walk(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "src_id string, dst_id string")
    seeds = spark.createDataFrame([("n0",)], "node_id string")
    reached = dict(ids(gr.expand_context(gr.adjacency(chain), seeds, 5), "node_id", "hop"))
    assert reached == {f"n{i}": i for i in range(6)}


def test_missing_and_null_ends(spark, star):
    customers, products, sales = star
    extra = spark.createDataFrame(
        [("S4", None, "P1", 1.0, 1), ("S5", "C9", "P1", 1.0, 1)], sales.schema
    )
    rows = sales.unionByName(extra)
    dims = {"Customer": customers, "Product": products}
    assert gr.build_edges(rows, MAPPING, dims).count() == 3
    assert gr.build_edges(rows, MAPPING).count() == 4
    assert gr.linked_pairs(rows, MAPPING, dims).count() == 3


def test_two_keys_into_one_table(spark):
    fact = spark.createDataFrame(
        [(1, 2, 7), (2, 1, 7), (1, 1, 7)], "buyer bigint, seller bigint, item bigint"
    )
    mapping = {"buyer": "person", "seller": "person", "item": "item"}
    edges = gr.build_edges(fact, mapping)
    assert edges.count() == 9
    want = ids(gr.adjacency(edges), "node_id", "neighbor_id")
    got = gr.adjacency_of(fact, mapping)
    assert got.count() == len(want) and ids(got, "node_id", "neighbor_id") == want
    pairs = gr.linked_pairs(fact, mapping)
    assert {r["edges"] for r in pairs.filter("src_id = 'person_1' AND dst_id = 'item_7'").collect()} == {4}


def test_totals_per_customer(star):
    _, _, sales = star
    edges = gr.build_edges(sales, {"product_id": "Product", "customer_id": "Customer"})
    facts = gr.subgraph_facts(edges, "Product", "Customer", "revenue", "quantity")
    totals = {r["dst_id"]: round(r["value"], 2) for r in facts.filter("level = 1").collect()}
    assert totals == {"Customer_C1": 1249.85, "Customer_C2": 499.95}
    assert facts.filter("level = 3").first()["purchases"] == 3


def test_round_trip(spark, star, tmp_path):
    customers, products, sales = star
    parts = {
        "nodes": gr.build_nodes({"Customer": customers, "Product": products}),
        "edges": gr.build_edges(sales, MAPPING),
        "embeddings": spark.createDataFrame([("Customer_C1", [0.5, 0.5])], "node_id string, embedding array<float>"),
    }
    graph_store.save_graph(str(tmp_path / "g"), **parts)
    for name, back in graph_store.load_graph(spark, str(tmp_path / "g")).items():
        assert result_diff(parts[name], back.select(*parts[name].columns)).isEmpty()


@pytest.mark.parametrize("pushed", [2000, 1])
def test_walks_from_the_fact(spark, pushed):
    """The same ball and edges as over the adjacency; unknown seeds stay, orphans and nulls link nothing."""
    rows = [(1, 1, 1), (1, 2, None), (2, 2, 2), (2, None, 3), (3, 3, 3), (4, 4, 4), (None, 4, 5), (6, None, None)]
    fact = spark.createDataFrame(rows, "item_id bigint, store_id bigint, customer_id bigint")
    mapping = {"item_id": "item", "store_id": "store", "customer_id": "customer"}
    seeds = spark.createDataFrame([("item_1",), ("item_01",), ("moon_7",)], "node_id string")
    for hops in (1, 2, 5):
        want = sorted(map(tuple, gr.expand_context(gr.adjacency_of(fact, mapping), seeds, hops).collect()))
        ball = gr.expand_facts(fact, mapping, seeds, hops, pushed)
        assert sorted(map(tuple, ball.collect())) == want
        edges = sorted(map(tuple, gr.induced_subgraph(gr.build_edges(fact, mapping), ball).collect()), key=repr)
        assert sorted(map(tuple, gr.induced_facts(fact, mapping, ball, pushed).collect()), key=repr) == edges
    assert gr.induced_facts(fact, mapping, seeds.limit(0)).count() == 0
