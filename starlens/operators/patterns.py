"""Who bought what: product matching, buyers of one, both or any of several products.  (F1-F11)

The dated and undated forms share one plan.  No fact is joined with itself: a customer's matching
rows are folded into flags and min/max item ids, which combine map-side, so a customer or an item
that holds a large share of the rows costs one accumulator per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.functions.dates import date_predicate
from starlens.joins import SALTS, lookup_join


def product_condition(
    ref: str | Column, key: str = "item_id", label: str = "item_name", case_sensitive: bool = False
) -> Column:
    """id equal to the reference, or name containing it (which includes name equality)."""
    ref = F.lit(ref) if isinstance(ref, str) else ref
    ident, name = F.col(key).cast("string"), F.col(label)
    if case_sensitive:
        return (ident == ref) | name.contains(ref)
    return (F.lower(ident) == F.lower(ref)) | F.lower(name).contains(F.lower(ref))


def match_products(
    items: DataFrame, ref: str, key: str = "item_id", label: str = "item_name", case_sensitive: bool = False
) -> DataFrame:
    """F1 (any case) and F2 (exact case): the items a product reference stands for."""
    return items.filter(product_condition(ref, key, label, case_sensitive))


def _dated(sales: DataFrame, date_column: str, year, month, quarter) -> DataFrame:
    if year is None and month is None and quarter is None:
        return sales
    return sales.filter(date_predicate(date_column, year, month, quarter))


def buyer_ids(
    sales: DataFrame, matched: DataFrame, key: str = "item_id", customer: str = "customer_id"
) -> DataFrame:
    """Distinct customers with at least one sale of a matched item."""
    hits = lookup_join(
        sales.select(key, customer), matched.select(key).distinct(), key, "left_semi", salts=SALTS
    )
    return hits.select(customer).distinct()


def customers_who_bought(
    sales: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    ref: str,
    year: int | None = None,
    month: int | None = None,
    quarter: int | None = None,
    case_sensitive: bool = False,
    date_column: str = "sale_date",
) -> DataFrame:
    """attributes of the customers who bought a product, within an optional period."""
    rows = _dated(sales, date_column, year, month, quarter)
    matched = match_products(items, ref, case_sensitive=case_sensitive)
    return customers.join(buyer_ids(rows, matched), "customer_id", "left_semi")


def _flagged(items: DataFrame, a: str, b: str, case_sensitive: bool) -> DataFrame:
    """Items that match a or b, with both flags."""
    flags = items.select(
        "item_id",
        product_condition(a, case_sensitive=case_sensitive).alias("is_a"),
        product_condition(b, case_sensitive=case_sensitive).alias("is_b"),
    )
    return (
        flags.filter("is_a OR is_b")
        .groupBy("item_id")
        .agg(F.max("is_a").alias("is_a"), F.max("is_b").alias("is_b"))
    )


def pair_profile(sales: DataFrame, items: DataFrame, a: str, b: str, case_sensitive: bool = False) -> DataFrame:
    """Per customer with a hit: bought a, bought b, and whether two different items can serve."""
    hits = lookup_join(
        sales.select("item_id", "customer_id"), _flagged(items, a, b, case_sensitive), "item_id", salts=SALTS
    )
    id_a, id_b = F.when(F.col("is_a"), F.col("item_id")), F.when(F.col("is_b"), F.col("item_id"))
    folded = hits.groupBy("customer_id").agg(
        F.min(id_a).alias("min_a"),
        F.max(id_a).alias("max_a"),
        F.min(id_b).alias("min_b"),
        F.max(id_b).alias("max_b"),
    )
    # Two different items exist unless both sets are the same single item.
    same_single = (
        (F.col("min_a") == F.col("max_a"))
        & (F.col("min_b") == F.col("max_b"))
        & (F.col("min_a") == F.col("min_b"))
    )
    has_a, has_b = F.col("min_a").isNotNull(), F.col("min_b").isNotNull()
    return folded.select(
        "customer_id",
        has_a.alias("has_a"),
        has_b.alias("has_b"),
        F.coalesce(has_a & has_b & ~same_single, F.lit(False)).alias("two_items"),
    )


def customers_who_bought_both(
    sales: DataFrame,
    items: DataFrame,
    customers: DataFrame,
    a: str,
    b: str,
    year: int | None = None,
    month: int | None = None,
    quarter: int | None = None,
    distinct_items: bool = False,
    case_sensitive: bool = False,
    date_column: str = "sale_date",
) -> DataFrame:
    """customers with a sale matching a and one matching b.

    ``distinct_items`` asks for two different item ids, as the dated form of the question does.
    """
    rows = _dated(sales, date_column, year, month, quarter)
    profile = pair_profile(rows, items, a, b, case_sensitive)
    keep = F.col("two_items") if distinct_items else F.col("has_a") & F.col("has_b")
    return customers.join(profile.filter(keep).select("customer_id"), "customer_id", "left_semi")


def pair_support(
    sales: DataFrame,
    items: DataFrame,
    a: str,
    b: str,
    year: int | None = None,
    month: int | None = None,
    quarter: int | None = None,
    case_sensitive: bool = False,
    date_column: str = "sale_date",
) -> DataFrame:
    """one row with the number of customers who bought a, b, and both."""
    rows = _dated(sales, date_column, year, month, quarter)
    return pair_profile(rows, items, a, b, case_sensitive).agg(
        F.count_if("has_a").alias("total_customers_with_a"),
        F.count_if("has_b").alias("total_customers_with_b"),
        F.count_if(F.col("has_a") & F.col("has_b")).alias("customers_with_both"),
        F.count_if("two_items").alias("customers_with_two_items"),
    )


def bought_both_by_name(
    view: DataFrame, a: str, b: str, item: str = "item_name", customer: str = "customer_name"
) -> DataFrame:
    """F8: pair query on the wide view by exact item name and customer name."""
    return (
        view.filter(F.col(item).isin(a, b))
        .groupBy(customer)
        .agg(F.max(F.col(item) == a).alias("has_a"), F.max(F.col(item) == b).alias("has_b"))
        .filter("has_a AND has_b")
        .select(customer)
    )


def mention_resolution(items: DataFrame, mentions: Sequence[str]) -> DataFrame:
    """one row per mention: number of matching items, the first of them, and a found flag.

    A literal list of mentions is tested against every item in one narrow pass, without a join.
    """
    wanted = list(dict.fromkeys(mentions))
    tested = F.array_compact(
        F.array(*[F.when(product_condition(m), F.lit(m)) for m in wanted])
    )
    hits = (
        items.select("item_id", F.explode(tested).alias("mention"))
        .groupBy("mention")
        .agg(F.countDistinct("item_id").alias("matches"), F.min("item_id").alias("first_item"))
    )
    spark = items.sparkSession
    asked = spark.createDataFrame([(i, m) for i, m in enumerate(wanted, 1)], "position bigint, mention string")
    return asked.join(hits, "mention", "left").select(
        "position",
        "mention",
        F.coalesce("matches", F.lit(0)).alias("matches"),
        "first_item",
        F.col("matches").isNotNull().alias("found"),
    )


def customers_who_bought_any(
    sales: DataFrame, items: DataFrame, customers: DataFrame, mentions: Sequence[str]
) -> DataFrame:
    """union of the buyers of the first matching item of each mention."""
    first = (
        mention_resolution(items, mentions).filter("found").select(F.col("first_item").alias("item_id"))
    )
    return customers.join(buyer_ids(sales, first), "customer_id", "left_semi")


def relation_summary(
    sales: DataFrame, items: DataFrame, a: str, b: str | None = None, **options
) -> DataFrame:
    """tells a product that does not exist from one that nobody bought.

    One row: found flags, customer counts and an outcome of ``product not found``,
    ``no customers`` or ``found``.
    """
    b_ref = a if b is None else b
    counts = pair_support(sales, items, a, b_ref, **options)
    found = items.agg(
        F.coalesce(F.max(product_condition(a)), F.lit(False)).alias("a_found"),
        F.coalesce(F.max(product_condition(b_ref)), F.lit(False)).alias("b_found"),
    )
    both = F.col("customers_with_both")
    return (
        counts.withColumn("f", found.select(F.struct("a_found", "b_found")).scalar())
        .select(
            F.lit(a).alias("product_a"),
            F.lit(b).alias("product_b"),
            F.col("f.a_found").alias("a_found"),
            F.col("f.b_found").alias("b_found"),
            "total_customers_with_a",
            "total_customers_with_b",
            both.alias("count"),
        )
        .withColumn(
            "outcome",
            F.when(~F.col("a_found") | ~F.col("b_found"), "product not found")
            .when(F.col("count") == 0, "no customers")
            .otherwise("found"),
        )
    )


def preview(df: DataFrame, order: str | Sequence[str], n: int = 10) -> DataFrame:
    """the first ``n`` rows in order, each with its position and the number of rows left out."""
    keys = [order] if isinstance(order, str) else list(order)
    total = df.agg(F.count(F.lit(1))).scalar()
    first = df.orderBy(*keys).limit(n)
    # The window runs over the n rows that are kept.
    position = F.row_number().over(Window.orderBy(*keys)).cast("bigint")
    return first.withColumn("position", position).withColumn(
        "more", F.greatest(total - F.lit(n), F.lit(0).cast("bigint"))
    )
