"""E*: star aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions.dates import date_between, date_predicate
from starlens.operators import aggregates as agg
from starlens.plans.book import Book
from starlens.sources.retail import Retail, denormalize

book = Book()
_VALUE = "total_sales_value"


def _money(df, *columns):
    return df.withColumns({c: F.round(c, 2) for c in columns})


@book.star(
    "e1_top_n_items_revenue",
    """
    SELECT item_id, item_name, round(sum(total_sales_value), 2) AS total_sales_value
    FROM sales JOIN items USING (item_id) GROUP BY item_id, item_name
    ORDER BY sum(total_sales_value) DESC, item_id LIMIT 5""",
)
def top_items(r):
    return _money(agg.top_n(r.sales("item_id", _VALUE), r.items(), "item_id", "item_name", _VALUE), _VALUE)


@book.star(
    "e1_top_n_customers_revenue",
    """
    SELECT customer_id, customer_name, round(sum(total_sales_value), 2) AS total_sales_value
    FROM sales JOIN customers USING (customer_id) GROUP BY customer_id, customer_name
    ORDER BY sum(total_sales_value) DESC, customer_id LIMIT 3""",
)
def top_customers(r):
    fact = r.sales("customer_id", _VALUE)
    return _money(agg.top_n(fact, r.customers(), "customer_id", "customer_name", _VALUE, 3), _VALUE)


@book.star(
    "e1_top_n_locations_units",
    """
    SELECT location_id, location_name, sum(units_sold) AS units_sold
    FROM sales JOIN locations USING (location_id) GROUP BY location_id, location_name
    ORDER BY sum(units_sold) DESC, location_id LIMIT 10""",
)
def top_locations(r):
    fact = r.sales("location_id", "units_sold")
    return agg.top_n(fact, r.locations(), "location_id", "location_name", "units_sold", 10)


class ArchivedOrders(Retail):
    """The tables after the orders before 1995 have been archived: their lines are orphans."""

    def table(self, name):
        rows = super().table(name)
        return rows.filter("o_orderdate >= DATE '1995-01-01'") if name == "orders" else rows


@book.query(
    "e1_totals_with_orphans",
    """WITH f AS (SELECT l_partkey AS item_id, o_custkey AS customer_id, s_nationkey AS location_id, l_extendedprice AS v
      FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= DATE '1995-01-01') ON l_orderkey = o_orderkey
      LEFT JOIN supplier ON l_suppkey = s_suppkey)
    SELECT 'item_id' AS dimension, round(sum(v), 2) AS total, round(coalesce(sum(v) FILTER (item_id IS NULL), 0), 2) AS unknown,
      count(DISTINCT item_id) AS members FROM f
    UNION ALL SELECT 'customer_id', round(sum(v), 2), round(coalesce(sum(v) FILTER (customer_id IS NULL), 0), 2), count(DISTINCT customer_id) FROM f
    UNION ALL SELECT 'location_id', round(sum(v), 2), round(coalesce(sum(v) FILTER (location_id IS NULL), 0), 2), count(DISTINCT location_id) FROM f""",
)
def e1_orphans(r):
    fact = ArchivedOrders(r.spark, r.root).sales("item_id", "customer_id", "location_id", "total_sales_value")
    out = agg.dimension_totals(fact, ["item_id", "customer_id", "location_id"])
    return out.withColumns({c: F.round(c, 2) for c in ("total", "unknown")})


@book.star(
    "e2_bottom_n_items_revenue",
    """
    SELECT item_id, item_name, round(sum(total_sales_value), 2) AS total_sales_value
    FROM sales JOIN items USING (item_id) GROUP BY item_id, item_name
    ORDER BY sum(total_sales_value), item_id LIMIT 5""",
)
def bottom_items(r):
    fact = r.sales("item_id", _VALUE)
    return _money(agg.top_n(fact, r.items(), "item_id", "item_name", _VALUE, bottom=True), _VALUE)


@book.star(
    "e3_top_n_customers_count",
    """
    SELECT customer_id, customer_name, count(*) AS transaction_count
    FROM sales JOIN customers USING (customer_id) GROUP BY customer_id, customer_name
    ORDER BY transaction_count DESC, customer_id LIMIT 10""",
)
def busiest_customers(r):
    return agg.top_n(r.sales("customer_id"), r.customers(), "customer_id", "customer_name", agg.COUNT, 10)


_E4_CASES = {
    "year": "year(sale_date) = 2000",
    "year_month": "year(sale_date) = 2000 AND month(sale_date) = 12",
    "year_quarter": "year(sale_date) = 2000 AND quarter(sale_date) = 4",
    "month": "month(sale_date) = 12",
    "quarter": "quarter(sale_date) = 2",
    "month_quarter": "month(sale_date) = 5 AND quarter(sale_date) = 2",
    "contradiction": "year(sale_date) = 2000 AND month(sale_date) = 5 AND quarter(sale_date) = 1",
}


@book.star(
    "e4_date_predicate",
    " UNION ALL ".join(
        f"SELECT '{name}' AS filter, count(*) AS transactions, sum(units_sold) AS units FROM sales WHERE {clause}"
        for name, clause in _E4_CASES.items()
        if name != "contradiction"
    ),
)
def date_filters(r):
    fact = r.sales("sale_date", "units_sold")
    cases = {
        "year": dict(year=2000),
        "year_month": dict(year=2000, month=12),
        "year_quarter": dict(year=2000, quarter=4),
        "month": dict(month=12),
        "quarter": dict(quarter=2),
        "month_quarter": dict(month=5, quarter=2),
    }
    # One scan: every filter tags the row, tags are counted together.
    tags = F.array_compact(
        F.array(*[F.when(date_predicate("sale_date", **c), F.lit(name)) for name, c in cases.items()])
    )
    return (
        fact.select(F.explode(tags).alias("filter"), "units_sold")
        .groupBy("filter")
        .agg(F.count(F.lit(1)).alias("transactions"), F.sum("units_sold").alias("units"))
    )


@book.star(
    "e4_top_n_items_month",
    """
    SELECT item_id, item_name, round(sum(total_sales_value), 2) AS total_sales_value
    FROM sales JOIN items USING (item_id) WHERE year(sale_date) = 2000 AND month(sale_date) = 12
    GROUP BY item_id, item_name ORDER BY sum(total_sales_value) DESC, item_id LIMIT 5""",
)
def top_items_month(r):
    fact = r.sales("item_id", "sale_date", _VALUE)
    return _money(
        agg.top_n(fact, r.items(), "item_id", "item_name", _VALUE, year=2000, month=12), _VALUE
    )


@book.star(
    "e4_top_n_locations_quarter",
    """
    SELECT location_id, location_name, round(sum(total_sales_value), 2) AS total_sales_value
    FROM sales JOIN locations USING (location_id) WHERE year(sale_date) = 2000 AND quarter(sale_date) = 4
    GROUP BY location_id, location_name ORDER BY sum(total_sales_value) DESC, location_id LIMIT 5""",
)
def top_locations_quarter(r):
    fact = r.sales("location_id", "sale_date", _VALUE)
    out = agg.top_n(fact, r.locations(), "location_id", "location_name", _VALUE, year=2000, quarter=4)
    return _money(out, _VALUE)


@book.star(
    "e5_date_between",
    """
    SELECT CAST(count(*) AS BIGINT) AS transactions, round(sum(total_sales_value), 2) AS total_sales_value,
           strftime(min(sale_date), '%Y-%m-%d') AS first_day, strftime(max(sale_date), '%Y-%m-%d') AS last_day
    FROM sales WHERE CAST(sale_date AS DATE) BETWEEN DATE '2000-11-15' AND DATE '2001-01-31'""",
)
def between(r):
    rows = date_between(r.sales("sale_date", _VALUE), "sale_date", "2000-11-15", "2001-01-31")
    return rows.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.round(F.sum(_VALUE), 2).alias(_VALUE),
        F.date_format(F.min("sale_date"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("sale_date"), "yyyy-MM-dd").alias("last_day"),
    )


@book.star(
    "e6_top_n_with_count",
    """
    SELECT item_id, item_name, round(sum(total_sales_value), 2) AS total_sales_value, count(*) AS transaction_count
    FROM sales JOIN items USING (item_id) GROUP BY item_id, item_name
    ORDER BY sum(total_sales_value) DESC, item_id LIMIT 5""",
)
def top_with_count(r):
    fact = r.sales("item_id", _VALUE)
    return _money(agg.top_n_with_count(fact, r.items(), "item_id", "item_name", _VALUE), _VALUE)


@book.star(
    "e7_top_n_with_description",
    """
    SELECT item_id, item_name, item_description, round(sum(total_sales_value), 2) AS total_sales_value
    FROM sales JOIN items USING (item_id) GROUP BY item_id, item_name, item_description
    ORDER BY sum(total_sales_value) DESC, item_id LIMIT 5""",
)
def top_with_description(r):
    fact = r.sales("item_id", _VALUE)
    out = agg.top_n(
        fact, r.items(), "item_id", "item_name", _VALUE, extra_keys=["item_description"]
    )
    return _money(out, _VALUE)


@book.star(
    "e8_top_n_by_name",
    """
    SELECT item_name, round(sum(total_sales_value), 2) AS total_sales_value, count(*) AS transaction_count
    FROM sales JOIN items USING (item_id) GROUP BY item_name
    ORDER BY sum(total_sales_value) DESC, item_name LIMIT 5""",
)
def top_by_name(r):
    fact = r.sales("item_id", _VALUE)
    return _money(agg.top_n_by_name(fact, r.items(), "item_id", "item_name", _VALUE), _VALUE)


@book.star(
    "e8_top_locations_by_name",
    """
    SELECT location_name, round(sum(total_sales_value), 2) AS total_sales_value, count(*) AS transaction_count
    FROM sales JOIN locations USING (location_id) GROUP BY location_name
    ORDER BY sum(total_sales_value) DESC, location_name LIMIT 5""",
)
def top_locations_by_name(r):
    fact = r.sales("location_id", _VALUE)
    return _money(agg.top_n_by_name(fact, r.locations(), "location_id", "location_name", _VALUE), _VALUE)


@book.star(
    "e9_top_n_units_month",
    """
    SELECT item_id, item_name, sum(units_sold) AS units_sold, count(*) AS transaction_count
    FROM sales JOIN items USING (item_id) WHERE year(sale_date) = 2000 AND month(sale_date) = 12
    GROUP BY item_id, item_name ORDER BY units_sold DESC, item_id LIMIT 5""",
)
def top_units_month(r):
    fact = r.sales("item_id", "sale_date", "units_sold")
    return agg.top_n_with_count(
        fact, r.items(), "item_id", "item_name", "units_sold", year=2000, month=12
    )


def _wide(r, *columns):
    return denormalize(
        r.sales("item_id", "customer_id", *columns),
        [(r.items(), "item_id", "item_id"), (r.customers(), "customer_id", "customer_id")],
    )


@book.star(
    "e10_top_n_denormalized",
    """
    SELECT item_name, round(sum(total_sales_value), 2) AS total_sales_value
    FROM sales JOIN items USING (item_id) JOIN customers USING (customer_id) GROUP BY item_name
    ORDER BY sum(total_sales_value) DESC, item_name LIMIT 5""",
)
def top_denormalized(r):
    return _money(agg.top_n_denormalized(_wide(r, _VALUE), "item_name", _VALUE), _VALUE)


@book.star(
    "e10_top_customers_denormalized_dated",
    """
    SELECT customer_name, round(sum(total_sales_value), 2) AS total_sales_value
    FROM sales JOIN items USING (item_id) JOIN customers USING (customer_id)
    WHERE sale_date >= '2000-12-01' AND sale_date <= '2000-12-31' GROUP BY customer_name
    ORDER BY sum(total_sales_value) DESC, customer_name LIMIT 3""",
)
def top_denormalized_dated(r):
    view = date_between(_wide(r, "sale_date", _VALUE), "sale_date", "2000-12-01", "2000-12-31")
    return _money(agg.top_n_denormalized(view, "customer_name", _VALUE, 3), _VALUE)


@book.star(
    "e11_distinct_buyers",
    "SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS buyers FROM sales",
)
def buyers(r):
    return agg.distinct_buyers(r.sales("customer_id"))


@book.star(
    "e11_distinct_buyers_by_item",
    "SELECT item_id, CAST(count(DISTINCT customer_id) AS BIGINT) AS buyers FROM sales GROUP BY item_id",
)
def buyers_by_item(r):
    return agg.distinct_buyers(r.sales("item_id", "customer_id"), by="item_id")
