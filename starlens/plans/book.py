"""Registry of queries and the SQL fragments they share."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starlens.sources.retail import Retail

SALES = """sales AS (
  SELECT l_orderkey AS order_id, l_partkey AS item_id, l_suppkey AS supplier_id,
         CAST(s_nationkey AS BIGINT) AS location_id, o_custkey AS customer_id,
         o_orderdate AS sale_date, l_quantity AS units_sold, l_extendedprice AS total_sales_value
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey)"""

ITEMS = """items AS (
  SELECT p_partkey AS item_id, p_name AS item_name, concat_ws(' ', p_brand, p_type) AS item_description
  FROM part)"""

CUSTOMERS = """customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS customer_segment,
         CAST(c_nationkey AS BIGINT) AS customer_nation FROM customer)"""

LOCATIONS = """locations AS (
  SELECT CAST(n_nationkey AS BIGINT) AS location_id, n_name AS location_name,
         CAST(n_regionkey AS BIGINT) AS region_id FROM nation)"""

STAR = ",\n".join((SALES, ITEMS, CUSTOMERS, LOCATIONS))


def with_star(body: str) -> str:
    return f"WITH {STAR}\n{inspect.cleandoc(body)}"


class Book:
    """Collects ``(spark, folder) -> DataFrame`` callables and their SQL twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def register(fn: Callable[[Retail], DataFrame]):
            self.queries[name] = lambda spark, root: fn(Retail(spark, root))
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register

    def star(self, name: str, body: str):
        """Register with SQL over the shared star definitions."""
        return self.query(name, with_star(body))
