"""Question and response logs that Spark derives from the tables, with the same texts in SQL.

Orders, items and user turns each contribute one question per row, so the log grows with the data.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from starlens.joins import spread

ORDER_QUESTIONS = (
    ("Top {n} customers by sales in {month} {year}", "simple"),
    ("What are the top {n} items by revenue in {month} {year}?", "simple"),
    ("Bottom {n} items by sales", "simple"),
    ("Top {n} customers in Q{quarter} {year}", "simple"),
    ("Show top {n} locations by sales in Q{quarter} {year}", "simple"),
    ("Top items in {month} {year}", "simple"),
    ("Show me items with above-average revenue per unit sold", "complex"),
    ("Which customers have made purchases in at least {n} different locations?", "complex"),
    ("Calculate the revenue contribution percentage for each item", "complex"),
    ("What's the average number of days between purchases for each customer?", "complex"),
    ("Show the month-over-month revenue growth in year {year}", "complex"),
    ("Items with declining sales over the last {n} months", "complex"),
    ("Which are the most popular store locations?", "complex"),
    ("How many customers bought items?", "simple"),
    ("Underperforming locations", "semantic"),
    ("Show me something interesting about {month}", "semantic"),
    ("Show top items this year", "simple"),
    ("List {n} best stores by volume last month", "simple"),
    ("Units sold in {m}/{year} by location", "simple"),
    ("Sales of products in month {m} last year", "semantic"),
    ("Which orders may have a large margin?", "semantic"),
    ("Total transactions this month", "simple"),
)

ITEM_QUESTIONS = (
    ('Which customers bought "{name}"?', "pattern"),
    ('Which customers who bought "{name}" also bought "{kind}"?', "pattern"),
    ('Find customers who bought "{name}" in December 2000', "pattern"),
    ("Which customers purchased p-{key}?", "pattern"),
    ("Customers who bought {title} in Q4", "pattern"),
    ("Find customers who bought 'new ring' and '{name}'", "pattern"),
    ("Show me {name} items", "semantic"),
    ("Find premium {name} products with rich finish", "semantic"),
    ("Items like {name} sold together", "complex"),
)

RESPONSES = (
    "```sql\nSELECT * FROM items WHERE item_name = '{name}'\n```",
    "Here is the query:\n\n  select item_id\n  from items\n  where brand = '{kind}'\n",
    "```\nWITH t AS (SELECT 1)\nSELECT * FROM t -- {name}\n```\nThis selects one row.",
    "I cannot answer a question about {name}.",
    "Error: no table for {kind}",
    "Explanation of {name}.\nDELETE FROM items WHERE item_id = {key};\nDone.",
)


def _pieces(template: str):
    return [p for p in re.split(r"(\{\w+\})", template) if p]


def _spark_text(template: str, fields: dict):
    return F.concat(*[fields[p[1:-1]] if p.startswith("{") else F.lit(p) for p in _pieces(template)])


def _sql_text(template: str, fields: dict) -> str:
    def literal(p):
        return "'" + p.replace("'", "''") + "'"

    parts = [fields[p[1:-1]] if p.startswith("{") else literal(p) for p in _pieces(template)]
    return " || ".join(parts)


def _spark_choice(key, templates, make):
    out = None
    for i, t in enumerate(templates):
        hit = F.pmod(key, F.lit(len(templates))) == i
        out = F.when(hit, make(t)) if out is None else out.when(hit, make(t))
    return out


def _sql_choice(key: str, templates, make) -> str:
    cases = " ".join(f"WHEN {i} THEN {make(t)}" for i, t in enumerate(templates))
    return f"CASE {key} % {len(templates)} {cases} END"


def _order_fields():
    date = F.col("o_orderdate")
    return {
        "n": (F.pmod("o_custkey", F.lit(12)) + 1).cast("string"),
        "month": F.date_format(date, "MMMM"),
        "m": F.month(date).cast("string"),
        "year": F.year(date).cast("string"),
        "quarter": F.quarter(date).cast("string"),
    }


_ORDER_SQL = {
    "n": "CAST(o_custkey % 12 + 1 AS VARCHAR)",
    "month": "strftime(o_orderdate, '%B')",
    "m": "CAST(month(o_orderdate) AS VARCHAR)",
    "year": "CAST(year(o_orderdate) AS VARCHAR)",
    "quarter": "CAST(quarter(o_orderdate) AS VARCHAR)",
}


def _item_fields():
    return {
        "name": F.col("p_name"),
        "kind": F.col("p_type"),
        "key": F.col("p_partkey").cast("string"),
        "title": F.initcap("p_name"),
    }


_TITLE = (
    "upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]"
)
_ITEM_SQL = {"name": "p_name", "kind": "p_type", "key": "CAST(p_partkey AS VARCHAR)", "title": _TITLE}


def question_log(r):
    """question_id, question, expected route."""
    orders = spread(r.table("orders")).select(
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("question_id"),
        _spark_choice(F.col("o_orderkey"), ORDER_QUESTIONS, lambda t: _spark_text(t[0], _order_fields())).alias("question"),
        _spark_choice(F.col("o_orderkey"), ORDER_QUESTIONS, lambda t: F.lit(t[1])).alias("expected"),
    )
    items = r.table("part").select(
        F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("question_id"),
        _spark_choice(F.col("p_partkey"), ITEM_QUESTIONS, lambda t: _spark_text(t[0], _item_fields())).alias("question"),
        _spark_choice(F.col("p_partkey"), ITEM_QUESTIONS, lambda t: F.lit(t[1])).alias("expected"),
    )
    turns = r.table("conversations").filter("role = 'user'").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.col("text").alias("question"),
        F.lit("semantic").alias("expected"),
    )
    return orders.unionByName(items).unionByName(turns)


QUESTIONS = f"""questions AS (
  SELECT 'o-' || o_orderkey AS question_id,
    {_sql_choice('o_orderkey', ORDER_QUESTIONS, lambda t: _sql_text(t[0], _ORDER_SQL))} AS question,
    {_sql_choice('o_orderkey', ORDER_QUESTIONS, lambda t: f"'{t[1]}'")} AS expected FROM orders
  UNION ALL
  SELECT 'p-' || p_partkey, {_sql_choice('p_partkey', ITEM_QUESTIONS, lambda t: _sql_text(t[0], _ITEM_SQL))},
    {_sql_choice('p_partkey', ITEM_QUESTIONS, lambda t: f"'{t[1]}'")} FROM part
  UNION ALL
  SELECT 'c-' || conv_id || '-' || turn, text, 'semantic' FROM conversations WHERE role = 'user')"""


def response_log(r):
    """response_id, response."""
    return r.table("part").select(
        F.col("p_partkey").alias("response_id"),
        _spark_choice(F.col("p_partkey"), RESPONSES, lambda t: _spark_text(t, _item_fields())).alias("response"),
    )


RESPONSE_LOG = f"""responses AS (
  SELECT p_partkey AS response_id, {_sql_choice('p_partkey', RESPONSES, lambda t: _sql_text(t, _ITEM_SQL))} AS response
  FROM part)"""
