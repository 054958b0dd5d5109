"""A*: sources, sinks, schema listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from starlens.operators import evaluate as ev
from starlens.plans.book import Book
from starlens.plans.graph import edges, nodes
from starlens.session import checkpoint_dir
from starlens.sources import graph_store, tables
from starlens.sources.retail import denormalize, generated_facts

book = Book()


def scratch(r, name: str) -> str:
    """A fresh folder below the session's shared checkpoint folder."""
    return f"{checkpoint_dir(r.spark)}/starlens-{name}-{uuid.uuid4().hex}"


@book.query(
    "a1_load_table",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS units FROM lineitem GROUP BY ALL""",
)
def a1(r):
    r.table("lineitem").createOrReplaceTempView("starlens_lines")
    lines = tables.load_table(r.spark, "starlens_lines")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("units")
    )


@book.star(
    "a2_load_csv_dimension",
    """
    SELECT 'c-' || customer_id AS customer_id, customer_name, 'Lives in nation ' || customer_nation || ', "' || customer_segment || '"'
      AS customer_email, lpad(CAST(customer_nation AS VARCHAR), 5, '0') AS customer_zip_code FROM customers""",
)
def a2(r):
    path = scratch(r, "csv")
    rows = r.customers().select(
        F.concat(F.lit("c-"), "customer_id").alias("customer_id"),
        "customer_name",
        F.concat(F.lit("Lives in nation "), "customer_nation", F.lit(', "'), "customer_segment", F.lit('"')).alias(
            "customer_email"
        ),
        F.lpad(F.col("customer_nation").cast("string"), 5, "0").alias("customer_zip_code"),
    )
    tables.write_csv(rows, path)
    return tables.load_csv_dimension(r.spark, path, table="customer_details")


@book.star(
    "a3_rows_to_table",
    """
    , tiers(customer_segment, tier) AS (VALUES ('BUILDING', 'trade'), ('MACHINERY', 'trade'), ('HOUSEHOLD', 'home'))
    SELECT tier, count(*) AS customers FROM customers JOIN tiers USING (customer_segment) GROUP BY tier""",
)
def a3(r):
    rows = [("BUILDING", "trade"), ("MACHINERY", "trade"), ("HOUSEHOLD", "home")]
    tiers = tables.rows_to_table(r.spark, rows, "customer_segment string, tier string")
    return r.customers().join(tiers, "customer_segment").groupBy("tier").agg(F.count(F.lit(1)).alias("customers"))


@book.query(
    "a4_generate_star",
    """
    WITH d AS (
      SELECT l_orderkey, l_linenumber, md5('who|7|' || l_orderkey || '|' || l_linenumber) AS who,
             md5('what|7|' || l_orderkey || '|' || l_linenumber) AS what FROM lineitem),
    n AS (
      SELECT l_orderkey, l_linenumber, CAST('0x' || who[1:8] AS BIGINT) AS item, CAST('0x' || who[9:16] AS BIGINT) AS place,
             CAST('0x' || who[17:24] AS BIGINT) AS buyer, CAST('0x' || who[25:32] AS BIGINT) AS day,
             CAST('0x' || what[1:8] AS BIGINT) % 20 + 1 AS units,
             CAST('0x' || what[9:16] AS BIGINT) % 9000001 + 1000000 AS price FROM d)
    SELECT l_orderkey, l_linenumber, 'p-' || (item % 500 + 1) AS item_id, 'l-' || (place % 50 + 1) AS location_id,
           'c-' || (buyer % 2000 + 1) AS customer_id, DATE '2024-01-01' + CAST(day % 730 AS INTEGER) AS sale_date,
           units AS units_sold, CAST((units * price + 5000) // 10000 AS DOUBLE) / 100 AS total_sales_value FROM n""",
)
def a4(r):
    return generated_facts(r.table("lineitem"), ["l_orderkey", "l_linenumber"], 7, n_items=500, n_customers=2000)


@book.star(
    "a5_save_table",
    """
    SELECT CAST(year(sale_date) AS BIGINT) AS sale_year, count(*) AS n, sum(units_sold) AS units,
           round(sum(total_sales_value), 2) AS value FROM sales GROUP BY 1""",
)
def a5(r):
    path = scratch(r, "sales")
    fact = r.sales("sale_date", "units_sold")
    tables.save_table(fact, path=path)
    # The second write replaces data and schema, and splits the fact by year.
    wide = r.sales("sale_date", "units_sold", "total_sales_value")
    tables.save_table(
        wide.withColumn("sale_year", F.year("sale_date").cast("bigint")), path=path, partition_by=["sale_year"]
    )
    return (
        r.spark.read.parquet(path)
        .groupBy(F.col("sale_year").cast("bigint").alias("sale_year"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("units_sold").alias("units"),
            F.round(F.sum("total_sales_value"), 2).alias("value"),
        )
    )


# Column names and types of the shipped tables, as the listing shows them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
_LISTED = [
    (t, i, *c.split(" ")) for t, columns in SCHEMAS.items() for i, c in enumerate(columns.split(", "), 1)
]


@book.query(
    "a6_describe_tables",
    "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({i} AS BIGINT) AS position, '{c}' AS col_name, '{kind}' AS data_type, "
        f"count(*) AS row_count, count({c}) AS non_null FROM {t}"
        for t, i, c, kind in _LISTED
    ),
)
def a6(r):
    listed = tables.folder_tables(r.spark, r.root)
    return tables.describe_tables(listed).join(tables.profile_columns(listed), ["table_name", "col_name"])


@book.star(
    "a7_denormalize_star",
    """
    SELECT order_id, item_id, customer_id, location_id, strftime(sale_date, '%Y-%m-%d') AS sale_date, units_sold,
           round(total_sales_value, 2) AS total_sales_value, item_name, item_description, customer_name,
           customer_segment, location_name
    FROM sales JOIN items USING (item_id) JOIN customers USING (customer_id) JOIN locations USING (location_id)""",
)
def a7(r):
    fact = r.sales(
        "order_id", "item_id", "customer_id", "location_id", "sale_date", "units_sold", "total_sales_value"
    )
    wide = denormalize(
        fact,
        [
            (r.items(), "item_id", "item_id"),
            (r.customers().drop("customer_nation"), "customer_id", "customer_id"),
            (r.locations().drop("region_id"), "location_id", "location_id"),
        ],
    )
    return wide.withColumn("sale_date", F.date_format("sale_date", "yyyy-MM-dd")).withColumn(
        "total_sales_value", F.round("total_sales_value", 2)
    )


@book.query(
    "a8_graph_round_trip",
    """
    SELECT 'nodes' AS part, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS n,
           CAST(0 AS BIGINT) AS differing_rows
    UNION ALL SELECT 'edges', 3 * count(*), 0 FROM lineitem
    UNION ALL SELECT 'embeddings', count(*), 0 FROM embeddings""",
)
def a8(r):
    path = scratch(r, "graph")
    saved = {
        "nodes": nodes(r).select("node_id", "node_table", "node_key", "node_text"),
        "edges": edges(r, "units_sold"),
        "embeddings": r.table("embeddings").select("vec_id", "embedding"),
    }
    graph_store.save_graph(path, **saved)
    loaded = graph_store.load_graph(r.spark, path)
    out = None
    for part, df in saved.items():
        back = loaded[part].select(*df.columns)
        changed = ev.result_diff(df, back).agg(F.count(F.lit(1))).scalar()
        row = back.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(part).alias("part"), "n", changed.alias("differing_rows")
        )
        out = row if out is None else out.unionByName(row)
    return out
