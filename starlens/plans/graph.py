"""B*: graph queries over items, suppliers and customers."""

from __future__ import annotations

import inspect
from dataclasses import replace

from pyspark.sql import functions as F

from starlens.functions.text import stringify_attributes
from starlens.operators import aggregates as agg
from starlens.operators import graph as gr
from starlens.operators.patterns import preview
from starlens.plans.book import STAR, Book

book = Book()
MAPPING = {
    "item_id": "item_details",
    "supplier_id": "supplier_details",
    "customer_id": "customer_details",
}


def dims(r):
    return {
        "item_details": r.items(),
        "supplier_details": r.suppliers(),
        "customer_details": r.customers(),
    }


def nodes(r):
    return gr.build_nodes(dims(r))


def fact(r, *columns):
    return replace(r, deal=True).sales(*MAPPING, *columns)


def edges(r, *columns):
    return gr.build_edges(fact(r, *columns), MAPPING)


def adjacency(r):
    return gr.adjacency_of(fact(r), MAPPING)


GRAPH = """suppliers AS (
  SELECT s_suppkey AS supplier_id, s_name AS supplier_name, CAST(s_nationkey AS BIGINT) AS supplier_nation FROM supplier),
nodes AS (
  SELECT 'item_details_' || item_id AS node_id, 'item_details' AS node_table, CAST(item_id AS VARCHAR) AS node_key,
    concat_ws(' | ', 'item_id: ' || item_id, 'item_name: ' || item_name, 'item_description: ' || item_description) AS node_text
  FROM items
  UNION ALL
  SELECT 'supplier_details_' || supplier_id, 'supplier_details', CAST(supplier_id AS VARCHAR),
    concat_ws(' | ', 'supplier_id: ' || supplier_id, 'supplier_name: ' || supplier_name, 'supplier_nation: ' || supplier_nation)
  FROM suppliers
  UNION ALL
  SELECT 'customer_details_' || customer_id, 'customer_details', CAST(customer_id AS VARCHAR),
    concat_ws(' | ', 'customer_id: ' || customer_id, 'customer_name: ' || customer_name,
              'customer_segment: ' || customer_segment, 'customer_nation: ' || customer_nation)
  FROM customers),
edges AS (
  SELECT 'item_details_' || item_id AS src_id, 'supplier_details_' || supplier_id AS dst_id,
         'item_details' AS src_table, 'supplier_details' AS dst_table, * FROM sales
  UNION ALL
  SELECT 'item_details_' || item_id, 'customer_details_' || customer_id, 'item_details', 'customer_details', * FROM sales
  UNION ALL
  SELECT 'supplier_details_' || supplier_id, 'customer_details_' || customer_id,
         'supplier_details', 'customer_details', * FROM sales),
adj AS (SELECT src_id AS node_id, dst_id AS neighbor_id FROM edges UNION SELECT dst_id, src_id FROM edges),
hop1 AS (SELECT DISTINCT neighbor_id AS node_id FROM adj WHERE node_id = 'item_details_1'),
hop2 AS (SELECT DISTINCT neighbor_id AS node_id FROM adj WHERE node_id IN (SELECT node_id FROM hop1)
         AND neighbor_id <> 'item_details_1' AND neighbor_id NOT IN (SELECT node_id FROM hop1)),
ball AS (SELECT 'item_details_1' AS node_id, CAST(0 AS BIGINT) AS hop UNION ALL SELECT node_id, 1 FROM hop1
         UNION ALL SELECT node_id, 2 FROM hop2)"""


def with_graph(body: str) -> str:
    return f"WITH {STAR},\n{GRAPH}\n{inspect.cleandoc(body)}"


def seed(r):
    """The node of item 1, taken from the node table."""
    return nodes(r).filter("node_id = 'item_details_1'").select("node_id")


def context(r, hops):
    return gr.expand_facts(r.sales(*MAPPING), MAPPING, seed(r), hops)


@book.query("b1_build_nodes", with_graph("SELECT node_id, node_table, node_key FROM nodes"))
def b1(r):
    return nodes(r).select("node_id", "node_table", "node_key")


@book.query(
    "b2_build_edges",
    with_graph("""
    SELECT src_id, dst_id, src_table, dst_table, order_id, units_sold,
           round(total_sales_value, 2) AS total_sales_value FROM edges"""),
)
def b2(r):
    out = edges(r, "order_id", "units_sold", "total_sales_value")
    out = out.withColumn("total_sales_value", F.round("total_sales_value", 2))
    return out.drop(*MAPPING)


@book.query(
    "b2_edges_per_pair_type",
    with_graph("""
    SELECT src_table, dst_table, count(*) AS edges, sum(units_sold) AS units FROM edges GROUP BY ALL"""),
)
def b2_types(r):
    per_type = edges(r, "units_sold").groupBy("src_table", "dst_table")
    return per_type.agg(F.count(F.lit(1)).alias("edges"), F.sum("units_sold").alias("units"))


@book.query(
    "b3_edges_with_existing_ends",
    with_graph("""
    SELECT src_table, dst_table, count(*) AS edges, sum(units_sold) AS units FROM edges
    WHERE customer_id IN (SELECT customer_id FROM customers WHERE customer_segment = 'BUILDING')
       OR dst_table <> 'customer_details' GROUP BY ALL"""),
)
def b3(r):
    members = {**dims(r), "customer_details": r.customers().filter("customer_segment = 'BUILDING'")}
    out = gr.build_edges(fact(r, "units_sold"), MAPPING, members)
    return out.groupBy("src_table", "dst_table").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("units_sold").alias("units")
    )


@book.query(
    "b4_node_attributes",
    with_graph("""
    , best AS (SELECT item_id FROM sales GROUP BY item_id ORDER BY sum(total_sales_value) DESC, item_id LIMIT 5)
    SELECT node_id, item_name, item_description FROM nodes JOIN items ON node_key = CAST(item_id AS VARCHAR)
    WHERE node_table = 'item_details' AND item_id IN (SELECT item_id FROM best)"""),
)
def b4(r):
    best = agg.top_n(
        r.sales("item_id", "total_sales_value"), r.items(), "item_id", "item_name", "total_sales_value"
    )
    ids = best.select(gr.node_id("item_details", "item_id").alias("node_id"))
    return gr.node_attributes(nodes(r), ids).select("node_id", "item_name", "item_description")


@book.query("b5_node_text", with_graph("SELECT node_id, node_text FROM nodes"))
def b5(r):
    return nodes(r).select("node_id", "node_text")


@book.star(
    "b6_stringify_attributes",
    """
    SELECT CAST(customer_id AS VARCHAR) AS customer_id, customer_name, customer_segment,
           CAST(customer_nation AS VARCHAR) AS customer_nation FROM customers""",
)
def b6(r):
    return stringify_attributes(r.customers())


@book.query("b7_neighbors", with_graph("SELECT node_id, neighbor_id FROM adj WHERE node_id LIKE 'supplier%'"))
def b7(r):
    suppliers = nodes(r).filter("node_table = 'supplier_details'")
    return gr.neighbors(adjacency(r), suppliers)


@book.query("b7_adjacency_of_edges", with_graph("SELECT node_id, neighbor_id FROM adj"))
def b7_edges(r):
    return gr.adjacency(edges(r))


@book.query("b8_expand_context", with_graph("SELECT node_id, hop FROM ball"))
def b8(r):
    return context(r, 2)


@book.query("b8_expand_adjacency", with_graph("SELECT node_id, hop FROM ball"))
def b8_adjacency(r):
    return gr.expand_context(adjacency(r), seed(r), 2)


@book.query(
    "b9_induced_subgraph",
    with_graph("""
    , inside AS (SELECT node_id FROM ball WHERE hop <= 1)
    SELECT (SELECT count(*) FROM inside) AS nodes, count(*) AS edges FROM edges
    WHERE src_id IN (SELECT node_id FROM inside) AND dst_id IN (SELECT node_id FROM inside)"""),
)
def b9(r):
    inside = context(r, 1)
    return gr.sizes_of(gr.induced_facts(r.sales(*MAPPING), MAPPING, inside), inside)


@book.query(
    "b9_subgraph_texts",
    with_graph("""
    SELECT node_id, node_text, row_number() OVER (ORDER BY node_id) AS position,
           greatest(count(*) OVER () - 10, 0) AS more
    FROM nodes WHERE node_id IN (SELECT node_id FROM ball) ORDER BY node_id LIMIT 10"""),
)
def b9_texts(r):
    return preview(gr.node_attributes(nodes(r), context(r, 2)).select("node_id", "node_text"), "node_id")


@book.query(
    "b10_subgraph_facts",
    with_graph("""
    SELECT coalesce(dst_id, 'all') AS customer, coalesce(src_id, 'all') AS item,
           round(sum(total_sales_value), 2) AS value, sum(units_sold) AS units, count(*) AS purchases,
           CAST(grouping(dst_id) * 2 + grouping(src_id) AS BIGINT) AS level
    FROM edges WHERE src_table = 'item_details' AND dst_table = 'customer_details'
      AND src_id IN (SELECT node_id FROM ball) AND dst_id IN (SELECT node_id FROM ball)
    GROUP BY ROLLUP (dst_id, src_id)"""),
)
def b10(r):
    sold = ("units_sold", "total_sales_value")
    link = ("item_details", "customer_details")
    facts = gr.subgraph_facts(
        gr.induced_facts(r.sales(*MAPPING, *sold), MAPPING, context(r, 2), links=[link]),
        *link,
        "total_sales_value",
        "units_sold",
    )
    return facts.select(
        F.coalesce("dst_id", F.lit("all")).alias("customer"),
        F.coalesce("src_id", F.lit("all")).alias("item"),
        F.round("value", 2).alias("value"),
        "units",
        "purchases",
        "level",
    )


@book.query(
    "b11_graph_statistics",
    with_graph("""
    SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges,
           (SELECT max(len(embedding)) FROM embeddings) AS embedding_dim,
           'item_details, supplier_details, customer_details' AS dimension_tables, 'items_sales' AS fact_table"""),
)
def b11(r):
    return gr.graph_statistics(
        nodes(r), edges(r), r.table("embeddings"), list(MAPPING.values()), "items_sales"
    )


@book.query(
    "b11_counts_per_table",
    with_graph("""
    SELECT node_table AS part, count(*) AS n FROM nodes GROUP BY 1
    UNION ALL SELECT src_table || ' > ' || dst_table, count(*) FROM edges GROUP BY 1"""),
)
def b11_counts(r):
    of_nodes = gr.node_counts(nodes(r)).select(F.col("node_table").alias("part"), F.col("nodes").alias("n"))
    of_edges = gr.edge_counts(edges(r)).select(
        F.concat_ws(" > ", "src_table", "dst_table").alias("part"), F.col("edges").alias("n")
    )
    return of_nodes.unionByName(of_edges)


@book.query(
    "b12_degree",
    with_graph("""
    , ends AS (SELECT src_id AS node_id FROM edges UNION ALL SELECT dst_id FROM edges),
    d AS (SELECT node_id, count(*) AS degree FROM ends GROUP BY 1),
    k AS (SELECT node_id, count(*) AS neighbors FROM adj GROUP BY 1)
    SELECT node_id, degree, neighbors FROM d JOIN k USING (node_id)"""),
)
def b12(r):
    return gr.degree(gr.linked_pairs(fact(r), MAPPING))
