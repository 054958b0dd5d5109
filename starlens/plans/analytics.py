"""G*: analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions.dates import date_predicate
from starlens.joins import lookup_join
from starlens.operators import analytics as an
from starlens.plans.book import Book

book = Book()
V, U = an.VALUE, an.UNITS


def rounded(df, digits=2, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@book.star(
    "g1_above_average_ratio",
    """
    , r AS (SELECT item_id, sum(total_sales_value) / sum(units_sold) AS ratio FROM sales GROUP BY item_id)
    SELECT item_id, round(ratio, 6) AS ratio FROM r WHERE ratio > (SELECT avg(ratio) FROM r)""",
)
def g1(r):
    return rounded(an.above_average_ratio(r.sales("item_id", U, V), "item_id"), 6, "ratio")


@book.star(
    "g2_buyers_in_n_locations",
    """
    SELECT customer_id, count(DISTINCT location_id) AS locations FROM sales GROUP BY customer_id
    HAVING count(DISTINCT location_id) >= 15""",
)
def g2(r):
    return an.buyers_in_n_locations(r.sales("customer_id", "location_id"), 15)


@book.star(
    "g3_contribution_pct",
    """
    SELECT item_id, round(sum(total_sales_value), 2) AS total,
           round(100.0 * sum(total_sales_value) / (SELECT sum(total_sales_value) FROM sales), 6) AS contribution_pct
    FROM sales GROUP BY item_id""",
)
def g3(r):
    out = an.contribution_pct(r.sales("item_id", V), "item_id")
    return rounded(rounded(out, 2, "total"), 6, "contribution_pct")


@book.star(
    "g4_popular_in_not_in",
    """
    , u AS (SELECT item_id, location_id, sum(units_sold) AS units FROM sales GROUP BY ALL),
    popular AS (SELECT item_id, location_id, units FROM u x
      WHERE units > (SELECT avg(units) FROM u y WHERE y.location_id = x.location_id))
    SELECT item_id, units AS units_x FROM popular WHERE location_id = 3
      AND item_id NOT IN (SELECT item_id FROM popular WHERE location_id = 7)""",
)
def g4(r):
    return an.popular_in_not_in(r.sales("item_id", "location_id", U), 3, 7)


@book.star(
    "g5_avg_days_between",
    """
    , days AS (SELECT DISTINCT customer_id, CAST(sale_date AS DATE) AS day FROM sales),
    gaps AS (SELECT customer_id, date_diff('day', lag(day) OVER (PARTITION BY customer_id ORDER BY day), day) AS gap FROM days)
    SELECT customer_id, count(*) AS purchase_days, round(avg(gap), 6) AS avg_days
    FROM gaps GROUP BY customer_id HAVING count(*) >= 2""",
)
def g5(r):
    return rounded(an.avg_days_between(r.sales("customer_id", "sale_date")), 6, "avg_days")


_SERIES = """
    , s AS (SELECT {keys} CAST(date_trunc('{period}', sale_date) AS DATE) AS p, sum(total_sales_value) AS total
            FROM {source} {where} GROUP BY ALL),
    l AS (SELECT *, lag(total) OVER ({part} ORDER BY p) AS previous FROM s)
    SELECT {keys} strftime(p, '%Y-%m') AS period, round(total, 2) AS total, round(previous, 2) AS previous,
           round((total - previous) / previous, 6) AS growth FROM l"""


def _series(df):
    df = df.withColumn("period", F.date_format("period", "yyyy-MM"))
    return rounded(rounded(df, 2, "total", "previous"), 6, "growth")


@book.star(
    "g6_mom_growth_year",
    _SERIES.format(keys="", period="month", source="sales", where="WHERE year(sale_date) = 2000", part=""),
)
def g6(r):
    fact = r.sales("sale_date", V)
    return _series(an.mom_growth(fact, condition=date_predicate("sale_date", 2000)))


@book.star(
    "g6_mom_growth_by_brand",
    _SERIES.format(
        keys="p_brand,",
        period="month",
        source="sales JOIN part ON item_id = p_partkey",
        where="WHERE year(sale_date) = 2000",
        part="PARTITION BY p_brand",
    ),
)
def g6_brand(r):
    brands = r.table("part").select(F.col("p_partkey").alias("item_id"), "p_brand")
    year = r.sales("item_id", "sale_date", V).filter(date_predicate("sale_date", 2000))
    return _series(an.mom_growth(lookup_join(year, brands, "item_id"), "p_brand"))


@book.star(
    "g7_revenue_over_k_avg",
    """
    , t AS (SELECT item_id, sum(total_sales_value) AS total FROM sales GROUP BY item_id)
    SELECT item_id, round(total, 2) AS total FROM t WHERE total > 1.5 * (SELECT avg(total) FROM t)""",
)
def g7(r):
    return rounded(an.revenue_over_k_avg(r.sales("item_id", V), 1.5), 2, "total")


@book.star(
    "g8_above_median",
    """
    , t AS (SELECT item_id, sum(total_sales_value) AS total FROM sales GROUP BY item_id)
    SELECT item_id, round(total, 2) AS total FROM t WHERE total > (SELECT median(total) FROM t)""",
)
def g8(r):
    return rounded(an.above_median(r.sales("item_id", V), "item_id"), 2, "total")


@book.star(
    "g9_only_bought_above",
    """
    SELECT customer_id, round(min(total_sales_value / units_sold), 6) AS lowest_price FROM sales
    GROUP BY customer_id HAVING min(total_sales_value / units_sold) > 500""",
)
def g9(r):
    return rounded(an.only_bought_above(r.sales("customer_id", U, V), 500), 6, "lowest_price")


@book.star(
    "g10_above_average_units",
    """
    , t AS (SELECT item_id, sum(units_sold) AS total FROM sales GROUP BY item_id)
    SELECT item_id, total FROM t WHERE total > (SELECT avg(total) FROM t)""",
)
def g10(r):
    return an.above_average(r.sales("item_id", U), "item_id", U)


@book.star(
    "g11_above_average_customers",
    """
    , t AS (SELECT customer_id, sum(total_sales_value) AS total FROM sales GROUP BY customer_id)
    SELECT customer_id, round(total, 2) AS total FROM t WHERE total > (SELECT avg(total) FROM t)""",
)
def g11(r):
    return rounded(an.above_average(r.sales("customer_id", V), "customer_id"), 2, "total")


def _with_region(r, *columns):
    places = r.locations().select("location_id", "region_id")
    return lookup_join(r.sales("location_id", *columns), places, "location_id")


@book.star(
    "g12_sold_everywhere_regions",
    """
    SELECT item_id, count(DISTINCT region_id) AS locations FROM sales JOIN locations USING (location_id)
    GROUP BY item_id HAVING count(DISTINCT region_id) = (SELECT count(*) FROM region)""",
)
def g12(r):
    regions = r.table("region").select(F.col("r_regionkey").cast("bigint").alias("region_id"))
    return an.sold_everywhere(_with_region(r, "item_id"), regions, "region_id")


def _together(columns, least):
    """SQL of G13 over ``columns``, a query that gives (basket, item)."""
    return f"""
    , b AS (SELECT DISTINCT * FROM ({columns}) WHERE basket IS NOT NULL AND item IS NOT NULL),
    n AS (SELECT item, count(*) AS support FROM b GROUP BY item),
    p AS (SELECT x.item AS item_a, y.item AS item_b, count(*) AS support FROM b x JOIN b y
          ON x.basket = y.basket AND x.item < y.item GROUP BY ALL HAVING count(*) >= {least})
    SELECT item_a, item_b, p.support, round(p.support / na.support, 6) AS confidence,
           round(p.support * (SELECT count(DISTINCT basket) FROM b) / (na.support * nb.support), 6) AS lift
    FROM p JOIN n na ON item_a = na.item JOIN n nb ON item_b = nb.item"""


@book.star("g13_bought_together", _together("SELECT order_id AS basket, item_id AS item FROM sales", 2))
def g13(r):
    return rounded(an.bought_together(r.sales("order_id", "item_id"), 2), 6, "confidence", "lift")


@book.star("g13_bought_by_same_customers", _together("SELECT customer_id AS basket, item_id AS item FROM sales", 4))
def g13_customers(r):
    out = an.bought_together(r.sales("customer_id", "item_id"), 4, basket="customer_id")
    return rounded(out, 6, "confidence", "lift")


@book.star(
    "g13_suppliers_of_same_brands",
    _together("SELECT p_brand AS basket, supplier_id AS item FROM sales JOIN part ON p_partkey = item_id", 20),
)
def g13_brands(r):
    brands = r.table("part").select(F.col("p_partkey").alias("item_id"), "p_brand")
    sold = lookup_join(r.sales("item_id", "supplier_id"), brands, "item_id")
    return rounded(an.bought_together(sold, 20, basket="p_brand", item="supplier_id"), 6, "confidence", "lift")


@book.star(
    "g14_avg_basket_value",
    """
    , o AS (SELECT customer_id, order_id, sum(total_sales_value) AS v FROM sales GROUP BY ALL)
    SELECT customer_id, round(avg(v), 6) AS avg_order_value FROM o GROUP BY customer_id
    ORDER BY avg(v) DESC, customer_id LIMIT 10""",
)
def g14(r):
    fact = r.sales("customer_id", "order_id", V)
    return rounded(an.avg_basket_value(fact, 10), 6, "avg_order_value")


@book.star(
    "g15_declining_quarters",
    """
    , s AS (SELECT item_id, CAST(date_trunc('quarter', sale_date) AS DATE) AS p, sum(total_sales_value) AS total
            FROM sales GROUP BY ALL),
    l AS (SELECT *, lag(total, 1) OVER w AS p1, lag(total, 2) OVER w AS p2,
                 row_number() OVER (PARTITION BY item_id ORDER BY p DESC) AS rn
          FROM s WINDOW w AS (PARTITION BY item_id ORDER BY p))
    SELECT item_id, strftime(p, '%Y-%m') AS period, round(total, 2) AS latest
    FROM l WHERE rn = 1 AND total < p1 AND p1 < p2""",
)
def g15(r):
    out = an.declining(r.sales("item_id", "sale_date", V), "quarter", 3)
    return rounded(out.withColumn("period", F.date_format("period", "yyyy-MM")), 2, "latest")


@book.star(
    "g16_location_dominance",
    """
    , c AS (SELECT item_id, location_id, sum(total_sales_value) AS v FROM sales GROUP BY ALL),
    w AS (SELECT *, sum(v) OVER (PARTITION BY item_id) AS s, count(*) OVER (PARTITION BY item_id) AS n FROM c)
    SELECT item_id, round(v, 2) AS own, round((s - v) / (n - 1), 6) AS avg_others FROM w
    WHERE location_id = 3 AND n > 1 AND v > 2 * (s - v) / (n - 1)""",
)
def g16(r):
    out = an.location_dominance(r.sales("item_id", "location_id", V), 3)
    return rounded(rounded(out, 2, "own"), 6, "avg_others")


@book.star(
    "g17_top_variance",
    """
    SELECT item_id, round(var_samp(total_sales_value), 2) AS variance FROM sales GROUP BY item_id
    HAVING count(*) >= 2 ORDER BY var_samp(total_sales_value) DESC, item_id LIMIT 10""",
)
def g17(r):
    return rounded(an.top_variance(r.sales("item_id", V)), 2, "variance")


@book.star(
    "g18_most_consistent",
    """
    SELECT customer_id, count(*) AS purchases,
           round(stddev_samp(total_sales_value) / avg(total_sales_value), 6) AS variation
    FROM sales GROUP BY customer_id HAVING count(*) >= 2
    ORDER BY stddev_samp(total_sales_value) / avg(total_sales_value), customer_id LIMIT 10""",
)
def g18(r):
    return rounded(an.most_consistent(r.sales("customer_id", V)), 6, "variation")


@book.star(
    "g19_frequency_above_median",
    """
    , o AS (SELECT customer_id, count(DISTINCT order_id) AS orders FROM sales GROUP BY customer_id)
    SELECT customer_id, orders FROM o WHERE orders > (SELECT median(orders) FROM o)""",
)
def g19(r):
    return an.frequency_above_median(r.sales("customer_id", "order_id"))


@book.star(
    "g20_lifetime_value",
    """
    SELECT customer_id, customer_name, round(sum(total_sales_value), 2) AS lifetime_value
    FROM sales JOIN customers USING (customer_id) GROUP BY customer_id, customer_name""",
)
def g20(r):
    out = an.lifetime_value(r.sales("customer_id", V), r.customers())
    return rounded(out.select("customer_id", "customer_name", "lifetime_value"), 2, "lifetime_value")


@book.star(
    "g21_popularity",
    """
    , t AS (SELECT item_id, count(*) AS transactions, sum(units_sold) AS units FROM sales GROUP BY item_id)
    SELECT item_id, transactions, units, rank() OVER (ORDER BY transactions DESC) AS rank_by_transactions,
           rank() OVER (ORDER BY units DESC) AS rank_by_units FROM t""",
)
def g21(r):
    return an.popularity(r.sales("item_id", U))


@book.star(
    "g22_location_ranking",
    """
    , t AS (SELECT location_id, sum(total_sales_value) AS revenue, count(*) AS transactions FROM sales GROUP BY 1)
    SELECT location_id, round(revenue, 2) AS revenue, transactions,
           dense_rank() OVER (ORDER BY revenue DESC) AS revenue_rank FROM t""",
)
def g22(r):
    return rounded(an.location_ranking(r.sales("location_id", V)), 2, "revenue")


@book.star(
    "g23_best_ratio",
    """
    SELECT item_id, round(sum(total_sales_value) / sum(units_sold), 6) AS ratio FROM sales GROUP BY item_id
    ORDER BY sum(total_sales_value) / sum(units_sold) DESC, item_id LIMIT 10""",
)
def g23(r):
    return rounded(an.best_ratio(r.sales("item_id", U, V)), 6, "ratio")


@book.star(
    "g24_most_loyal",
    """
    SELECT customer_id, count(*) AS purchases FROM sales GROUP BY customer_id
    ORDER BY purchases DESC, customer_id LIMIT 10""",
)
def g24(r):
    return an.most_loyal(r.sales("customer_id"))


@book.star(
    "g25_below_average_locations",
    """
    , t AS (SELECT location_id, sum(total_sales_value) AS total FROM sales GROUP BY 1)
    SELECT location_id, round(total, 2) AS total FROM t WHERE total < (SELECT avg(total) FROM t)""",
)
def g25(r):
    return rounded(an.below_average(r.sales("location_id", V), "location_id"), 2, "total")


@book.star(
    "g26_value_within_demographic",
    """
    SELECT customer_id, customer_segment, round(sum(total_sales_value), 2) AS customer_value
    FROM sales JOIN customers USING (customer_id) WHERE customer_segment IN ('BUILDING', 'MACHINERY')
    GROUP BY customer_id, customer_segment""",
)
def g26(r):
    out = an.value_within_demographic(
        r.sales("customer_id", V), r.customers(), "customer_segment", ["BUILDING", "MACHINERY"]
    )
    return rounded(out.select("customer_id", "customer_segment", "customer_value"), 2, "customer_value")


@book.star(
    "g26_value_by_demographic",
    """
    , t AS (SELECT customer_id, sum(total_sales_value) AS v FROM sales GROUP BY 1)
    SELECT customer_nation, count(*) AS customers, round(sum(v), 2) AS total_value, round(avg(v), 6) AS avg_value
    FROM t JOIN customers USING (customer_id) GROUP BY customer_nation""",
)
def g26_groups(r):
    out = an.value_by_demographic(r.sales("customer_id", V), r.customers(), "customer_nation")
    return rounded(rounded(out, 2, "total_value"), 6, "avg_value")


@book.star(
    "g27_year_over_year",
    _SERIES.format(keys="", period="year", source="sales", where="", part=""),
)
def g27(r):
    return _series(an.period_trend(r.sales("sale_date", V), "year"))


@book.star(
    "g27_trend_slope",
    """
    , s AS (SELECT item_id, year(sale_date) AS y, sum(total_sales_value) AS total FROM sales GROUP BY ALL)
    SELECT item_id, count(*) AS periods, round(regr_slope(total, y - 2000), 6) AS slope FROM s GROUP BY item_id""",
)
def g27_slope(r):
    return rounded(an.trend_slope(r.sales("item_id", "sale_date", V), "item_id"), 6, "slope")


@book.star(
    "g28_ratio_per_customer",
    """
    SELECT location_id, round(sum(total_sales_value), 2) AS total, count(DISTINCT customer_id) AS members,
           round(sum(total_sales_value) / count(DISTINCT customer_id), 6) AS value_per_member
    FROM sales GROUP BY location_id""",
)
def g28(r):
    out = an.ratio_per(r.sales("location_id", "customer_id", V), "location_id", "customer_id")
    return rounded(rounded(out, 2, "total"), 6, "value_per_member")


@book.star(
    "g29_compare_locations",
    """
    , t AS (SELECT item_id, coalesce(sum(total_sales_value) FILTER (location_id = 3), 0) AS x,
              coalesce(sum(total_sales_value) FILTER (location_id = 7), 0) AS y
            FROM sales WHERE location_id IN (3, 7) GROUP BY item_id)
    SELECT item_id, round(x, 2) AS value_x, round(y, 2) AS value_y, round(x - y, 2) AS difference,
           round(x / nullif(y, 0), 6) AS ratio FROM t""",
)
def g29(r):
    out = an.compare_locations(r.sales("item_id", "location_id", V), 3, 7)
    return rounded(rounded(out, 2, "value_x", "value_y", "difference"), 6, "ratio")


@book.star(
    "g30_purchase_interval",
    """
    , t AS (SELECT customer_id, CAST(min(sale_date) AS DATE) AS a, CAST(max(sale_date) AS DATE) AS b,
              count(DISTINCT order_id) AS orders FROM sales GROUP BY customer_id)
    SELECT customer_id, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day, orders,
           date_diff('day', a, b) AS span_days,
           round(orders * 30.0 / nullif(date_diff('day', a, b), 0), 6) AS orders_per_30_days FROM t""",
)
def g30(r):
    out = an.purchase_interval(r.sales("customer_id", "order_id", "sale_date"))
    days = {c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")}
    return rounded(out.withColumns(days), 6, "orders_per_30_days")
