"""The canonical star over the shipped tables, synthetic stars, and the wide view.  (A4, A7)"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.joins import lookup_join, spread
from starlens.sources.tables import load_table

SALES_COLUMNS = (
    "order_id",
    "item_id",
    "supplier_id",
    "location_id",
    "customer_id",
    "sale_date",
    "units_sold",
    "total_sales_value",
)

_FROM_LINES = {
    "order_id": "l_orderkey",
    "item_id": "l_partkey",
    "supplier_id": "l_suppkey",
    "units_sold": "l_quantity",
    "total_sales_value": "l_extendedprice",
}
_FROM_ORDERS = {"customer_id": "o_custkey", "sale_date": "o_orderdate"}


@dataclass(frozen=True)
class Retail:
    """Loader of the fact and its dimensions from one folder of parquet tables.

    ``deal`` spreads a small fact over all cores, for work that is heavy per row.
    """

    spark: SparkSession
    root: str
    deal: bool = False

    def table(self, name: str) -> DataFrame:
        return load_table(self.spark, name, self.root)

    def sales(self, *columns: str) -> DataFrame:
        """The fact, restricted to ``columns``.

        One row for each line, whatever the columns.  Orders and suppliers are joined only when one of their
        columns is asked for, and a line whose order or supplier is missing keeps its row with nulls
        there, so totals over any dimension agree (see :func:`aggregates.dimension_totals`).
        """
        wanted = columns or SALES_COLUMNS
        lines = [c for c in wanted if c in _FROM_LINES]
        orders = [c for c in wanted if c in _FROM_ORDERS]
        fact = self.table("lineitem")
        needed = set(lines)
        if orders:
            needed.add("order_id")
        if "location_id" in wanted:
            needed.add("supplier_id")
        df = fact.select(*[F.col(_FROM_LINES[c]).alias(c) for c in _FROM_LINES if c in needed])
        if self.deal:
            df = spread(df)
        if orders:
            # Two table-sized sides: one shuffle each; adaptive execution splits hot orders.
            head = self.table("orders").select(
                F.col("o_orderkey").alias("order_id"),
                *[F.col(_FROM_ORDERS[c]).alias(c) for c in orders],
            )
            df = df.join(head, "order_id", "left")
        if "location_id" in wanted:
            df = lookup_join(df, self.supplier_nation(), "supplier_id", "left")
        return df.select(*wanted)

    def supplier_nation(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_nationkey").cast("bigint").alias("location_id"),
        )

    def items(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("item_name"),
            F.concat_ws(" ", "p_brand", "p_type").alias("item_description"),
        )

    def customers(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("customer_segment"),
            F.col("c_nationkey").cast("bigint").alias("customer_nation"),
        )

    def locations(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("location_id"),
            F.col("n_name").alias("location_name"),
            F.col("n_regionkey").cast("bigint").alias("region_id"),
        )

    def suppliers(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.col("s_nationkey").cast("bigint").alias("supplier_nation"),
        )


def denormalize(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Fact joined with each ``(dimension, fact key, dimension key)``; keys appear once."""
    wide = fact
    for dim, fact_key, dim_key in dims:
        renamed = dim.withColumnRenamed(dim_key, fact_key) if dim_key != fact_key else dim
        wide = lookup_join(wide, renamed, fact_key)
    return wide


def generated_facts(
    keys: DataFrame,
    key_columns: Sequence[str],
    seed: int = 42,
    n_items: int = 50,
    n_locations: int = 50,
    n_customers: int = 200,
    start: str = "2024-01-01",
    days: int = 730,
) -> DataFrame:
    """A4: one synthetic sale for each row of ``keys``, whose key columns are kept.

    Every value is cut from MD5 digests of (seed, key), so any task can be rerun alike, no row depends on its
    partition, and any engine with that function makes the same rows.  Prices are whole millionths from 1 to 10, and the
    value of a sale is rounded to cents in whole numbers.  A null key column counts as empty text.
    """
    name = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_columns))

    def number(digest: str, piece: int):
        """Eight hexadecimal digits of a digest."""
        return F.conv(F.substring(F.col(digest), 8 * piece + 1, 8), 16, 10).cast("bigint")

    def member(prefix: str, piece: int, n: int):
        return F.concat(F.lit(prefix), (number("__who", piece) % n + 1).cast("string"))

    digests = keys.select(
        *key_columns, F.md5(F.concat(F.lit("who|"), name)).alias("__who"), F.md5(F.concat(F.lit("what|"), name)).alias("__what")
    )
    price = number("__what", 1) % 9_000_001 + 1_000_000
    return digests.select(
        *key_columns,
        member("p-", 0, n_items).alias("item_id"),
        member("l-", 1, n_locations).alias("location_id"),
        member("c-", 2, n_customers).alias("customer_id"),
        F.date_add(F.lit(start).cast("date"), (number("__who", 3) % days).cast("int")).alias("sale_date"),
        (number("__what", 0) % 20 + 1).alias("units_sold"),
        price.alias("__price"),
    ).select(
        *key_columns,
        "item_id",
        "location_id",
        "customer_id",
        "sale_date",
        "units_sold",
        (F.floor((F.col("units_sold") * F.col("__price") + 5000) / 10_000).cast("double") / 100).alias("total_sales_value"),
    )


def generate_star(
    spark: SparkSession,
    n_facts: int = 5000,
    seed: int = 42,
    n_items: int = 50,
    n_locations: int = 50,
    n_customers: int = 200,
    start: str = "2024-01-01",
    days: int = 730,
) -> dict[str, DataFrame]:
    """A4: synthetic star of numbered sales (:func:`generated_facts`) and their three dimensions."""
    numbered = spark.range(n_facts)
    facts = generated_facts(numbered, ["id"], seed, n_items, n_locations, n_customers, start, days).drop("id")

    def dim(n: int, prefix: str, **columns):
        number = (F.col("id") + 1).cast("string")
        return spark.range(n).select(
            F.concat(F.lit(prefix[0] + "-"), number).alias(f"{prefix}_id"),
            *[make(number).alias(name) for name, make in columns.items()],
        )

    items = dim(
        n_items,
        "product",
        item_name=lambda n: F.concat(F.lit("Item "), n),
        item_description=lambda n: F.concat(F.lit("Description of item "), n),
    ).withColumnRenamed("product_id", "item_id")
    stores = dim(
        n_locations,
        "location",
        location_name=lambda n: F.concat(F.lit("City "), n),
        location_description=lambda n: F.concat(F.lit("Store located in City "), n),
    )
    customers = dim(
        n_customers,
        "customer",
        customer_name=lambda n: F.concat(F.lit("Customer "), n),
        customer_email=lambda n: F.concat(F.lit("customer"), n, F.lit("@example.com")),
        customer_zip_code=lambda n: F.lpad((F.lit(10000) + n.cast("int")).cast("string"), 5, "0"),
    )
    return {
        "items_sales": facts,
        "item_details": items,
        "store_location": stores,
        "customer_details": customers,
    }
