"""F*: relationship queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.operators import patterns as pat
from starlens.plans.book import Book, with_star
from starlens.sources.retail import denormalize

book = Book()
A, B = "red plate", "small widget"
MENTIONS = ("Red Plate", "17", "no such thing", "SMALL WIDGET", "bolt")


@book.star(
    "f1_match_products",
    "SELECT item_id, item_name FROM items WHERE lower(item_name) LIKE '%red pl%' OR lower(CAST(item_id AS VARCHAR)) = 'red pl'",
)
def match_any_case(r):
    return pat.match_products(r.items(), "Red Pl").select("item_id", "item_name")


@book.star(
    "f1_match_products_by_id",
    "SELECT item_id, item_name FROM items WHERE lower(item_name) LIKE '%17%' OR CAST(item_id AS VARCHAR) = '17'",
)
def match_by_id(r):
    return pat.match_products(r.items(), "17").select("item_id", "item_name")


@book.star(
    "f2_match_products_case_sensitive",
    "SELECT item_id, item_name FROM items WHERE item_name LIKE '%d pl%' OR CAST(item_id AS VARCHAR) = 'd pl'",
)
def match_exact_case(r):
    return pat.match_products(r.items(), "d pl", case_sensitive=True).select("item_id", "item_name")


@book.star(
    "f3_customers_who_bought",
    """
    SELECT DISTINCT customer_id, customer_name FROM sales JOIN items USING (item_id)
    JOIN customers USING (customer_id) WHERE item_name = 'red plate'""",
)
def bought(r):
    out = pat.customers_who_bought(r.sales("item_id", "customer_id"), r.items(), r.customers(), A)
    return out.select("customer_id", "customer_name")


_BOTH = """
    SELECT customer_id, customer_name FROM customers WHERE customer_id IN (
      SELECT customer_id FROM sales JOIN items USING (item_id) WHERE lower(item_name) LIKE '%red plate%'
      INTERSECT
      SELECT customer_id FROM sales JOIN items USING (item_id) WHERE lower(item_name) LIKE '%small widget%')"""


@book.star("f4_bought_both", _BOTH)
def bought_both(r):
    out = pat.customers_who_bought_both(
        r.sales("item_id", "customer_id"), r.items(), r.customers(), A, B
    )
    return out.select("customer_id", "customer_name")


@book.star(
    "f5_pair_support",
    """
    , hits AS (SELECT DISTINCT customer_id, item_id, item_name FROM sales JOIN items USING (item_id)
               WHERE item_name IN ('red plate', 'small widget')),
    a AS (SELECT DISTINCT customer_id FROM hits WHERE item_name = 'red plate'),
    b AS (SELECT DISTINCT customer_id FROM hits WHERE item_name = 'small widget')
    SELECT (SELECT count(*) FROM a) AS total_customers_with_a, (SELECT count(*) FROM b) AS total_customers_with_b,
           (SELECT count(*) FROM a JOIN b USING (customer_id)) AS customers_with_both,
           (SELECT count(*) FROM a JOIN b USING (customer_id)) AS customers_with_two_items""",
)
def support(r):
    return pat.pair_support(r.sales("item_id", "customer_id"), r.items(), A, B)


@book.star(
    "f6_bought_dated",
    """
    SELECT DISTINCT customer_id, customer_name FROM sales JOIN items USING (item_id)
    JOIN customers USING (customer_id)
    WHERE item_name LIKE '%red plate%' AND year(sale_date) = 2000 AND month(sale_date) = 12""",
)
def bought_dated(r):
    fact = r.sales("item_id", "customer_id", "sale_date")
    out = pat.customers_who_bought(
        fact, r.items(), r.customers(), A, year=2000, month=12, case_sensitive=True
    )
    return out.select("customer_id", "customer_name")


def _self_join(a: str, b: str, when: str) -> str:
    return f"""
    SELECT DISTINCT c.customer_id, c.customer_name
    FROM sales s1 JOIN sales s2 ON s1.customer_id = s2.customer_id
    JOIN customers c ON s1.customer_id = c.customer_id
    JOIN items i1 ON s1.item_id = i1.item_id JOIN items i2 ON s2.item_id = i2.item_id
    WHERE i1.item_name LIKE '%{a}%' AND i2.item_name LIKE '%{b}%' AND s1.item_id <> s2.item_id
      AND {when.replace('@', 's1')} AND {when.replace('@', 's2')}"""


@book.star("f7_bought_both_dated", _self_join(A, B, "year(@.sale_date) = 2000"))
def bought_both_dated(r):
    fact = r.sales("item_id", "customer_id", "sale_date")
    out = pat.customers_who_bought_both(
        fact, r.items(), r.customers(), A, B, year=2000, distinct_items=True, case_sensitive=True
    )
    return out.select("customer_id", "customer_name")


@book.star(
    "f7_bought_two_of_same_name",
    _self_join("red plate", "red", "year(@.sale_date) = 2000 AND quarter(@.sale_date) = 4"),
)
def bought_overlapping(r):
    fact = r.sales("item_id", "customer_id", "sale_date")
    out = pat.customers_who_bought_both(
        fact,
        r.items(),
        r.customers(),
        A,
        "red",
        year=2000,
        quarter=4,
        distinct_items=True,
        case_sensitive=True,
    )
    return out.select("customer_id", "customer_name")


@book.star(
    "f8_bought_both_by_name",
    """
    , agg_table AS (SELECT * FROM sales JOIN items USING (item_id) JOIN customers USING (customer_id))
    SELECT DISTINCT a.customer_name FROM agg_table a JOIN agg_table b ON a.customer_name = b.customer_name
    WHERE a.item_name = 'red plate' AND b.item_name = 'small widget'""",
)
def both_by_name(r):
    view = denormalize(
        r.sales("item_id", "customer_id"),
        [(r.items(), "item_id", "item_id"), (r.customers(), "customer_id", "customer_id")],
    )
    return pat.bought_both_by_name(view, A, B)


def _mentions_sql(body: str) -> str:
    values = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MENTIONS, 1))
    return with_star(f"""
    , asked(position, mention) AS (VALUES {values}),
    resolved AS (
      SELECT CAST(position AS BIGINT) AS position, mention, count(item_id) AS matches, min(item_id) AS first_item
      FROM asked LEFT JOIN items ON lower(CAST(item_id AS VARCHAR)) = lower(mention)
        OR contains(lower(item_name), lower(mention)) GROUP BY ALL)
    {body}""")


@book.query(
    "f9_bought_any",
    _mentions_sql("""
    SELECT customer_id, customer_name FROM customers WHERE customer_id IN (
      SELECT customer_id FROM sales WHERE item_id IN (SELECT first_item FROM resolved))"""),
)
def bought_any(r):
    out = pat.customers_who_bought_any(
        r.sales("item_id", "customer_id"), r.items(), r.customers(), MENTIONS
    )
    return out.select("customer_id", "customer_name")


@book.query(
    "f10_mention_resolution",
    _mentions_sql("""
    SELECT position, mention, matches, coalesce(first_item, -1) AS first_item, first_item IS NOT NULL AS found
    FROM resolved"""),
)
def resolution(r):
    out = pat.mention_resolution(r.items(), MENTIONS)
    return out.withColumn("first_item", F.coalesce("first_item", F.lit(-1).cast("bigint")))


@book.star(
    "f10_not_found_or_no_customers",
    """
    , asked(product_a, product_b) AS (VALUES ('red plate', 'purple plate'), ('red plate', 'small widget')),
    pairs AS (SELECT DISTINCT customer_id, lower(item_name) AS name FROM sales JOIN items USING (item_id)),
    counted AS (
      SELECT product_a, product_b,
        EXISTS (SELECT 1 FROM items WHERE contains(lower(item_name), product_a)) AS a_found,
        EXISTS (SELECT 1 FROM items WHERE contains(lower(item_name), product_b)) AS b_found,
        (SELECT count(DISTINCT customer_id) FROM pairs WHERE contains(name, product_a)) AS total_customers_with_a,
        (SELECT count(DISTINCT customer_id) FROM pairs WHERE contains(name, product_b)) AS total_customers_with_b,
        (SELECT count(*) FROM (SELECT customer_id FROM pairs WHERE contains(name, product_a) INTERSECT
                               SELECT customer_id FROM pairs WHERE contains(name, product_b))) AS "count"
      FROM asked)
    SELECT *, CASE WHEN NOT a_found OR NOT b_found THEN 'product not found' WHEN "count" = 0 THEN 'no customers'
                   ELSE 'found' END AS outcome FROM counted""",
)
def outcomes(r):
    fact = r.sales("item_id", "customer_id")
    return pat.relation_summary(fact, r.items(), A, "purple plate").unionByName(
        pat.relation_summary(fact, r.items(), A, B)
    )


@book.query(
    "f11_preview",
    with_star(f"""
    , bought AS ({_BOTH})
    SELECT customer_id, customer_name, row_number() OVER (ORDER BY customer_id) AS position,
           (SELECT greatest(count(*) - 10, 0) FROM bought) AS more
    FROM bought ORDER BY customer_id LIMIT 10"""),
)
def previewed(r):
    return pat.preview(bought_both(r), "customer_id")
