"""Top-N and bottom-N star aggregations.  (E1-E3, E6-E11)

Measures are summed per foreign key before the dimension is joined: the map-side combine leaves at
most one row per key and task, so neither a hot key nor the width of the join grows with the fact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions.dates import date_predicate

COUNT = "count"
COUNT_ALIAS = "transaction_count"


def measure_alias(measure: str) -> str:
    return COUNT_ALIAS if measure == COUNT else measure


def _dated(fact: DataFrame, date_column: str, year, month, quarter) -> DataFrame:
    if year is None and month is None and quarter is None:
        return fact
    return fact.filter(date_predicate(date_column, year, month, quarter))


def _ordered(df: DataFrame, value: str, ties: Sequence[str], n: int | None, bottom: bool) -> DataFrame:
    first: Column = F.asc(value) if bottom else F.desc(value)
    out = df.orderBy(first, *[F.asc(t) for t in ties])
    return out if n is None else out.limit(n)


def _grouped(
    fact: DataFrame, dim: DataFrame, key: str, fact_key: str, group: Sequence[str], measure: str, counted: bool
) -> DataFrame:
    value = measure_alias(measure)
    aggs = [F.count(F.lit(1)).alias(COUNT_ALIAS)] if counted or measure == COUNT else []
    if measure != COUNT:
        aggs.insert(0, F.sum(measure).alias(value))
    per_key = fact.groupBy(F.col(fact_key).alias(key)).agg(*aggs)
    names = [c for c in per_key.columns if c != key]
    labels = dim.select(key, *[c for c in group if c != key])
    return per_key.join(labels, key).groupBy(*group).agg(*[F.sum(c).alias(c) for c in names])


def top_n(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    label: str,
    measure: str,
    n: int | None = 5,
    bottom: bool = False,
    fact_key: str | None = None,
    extra_keys: Sequence[str] = (),
    with_count: bool = False,
    date_column: str = "sale_date",
    year: int | None = None,
    month: int | None = None,
    quarter: int | None = None,
) -> DataFrame:
    """Entities ranked by a summed measure, or by their number of rows.

    ``measure="count"`` counts rows; ``with_count`` adds the row count beside a sum; ``extra_keys``
    carries further dimension columns.  Ties are broken by the key.
    """
    rows = _dated(fact, date_column, year, month, quarter)
    group = [key, label, *extra_keys]
    totals = _grouped(rows, dim, key, fact_key or key, group, measure, with_count)
    return _ordered(totals, measure_alias(measure), group, n, bottom)


def top_n_with_count(fact, dim, key, label, measure="total_sales_value", n=5, **options) -> DataFrame:
    """The sum and the number of transactions side by side."""
    return top_n(fact, dim, key, label, measure, n, with_count=True, **options)


def top_n_by_name(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    label: str,
    measure: str,
    n: int | None = 5,
    bottom: bool = False,
    fact_key: str | None = None,
    date_column: str = "sale_date",
    year: int | None = None,
    month: int | None = None,
    quarter: int | None = None,
) -> DataFrame:
    """Grouped by the label alone, so entities that share a name are added up."""
    rows = _dated(fact, date_column, year, month, quarter)
    totals = _grouped(rows, dim, key, fact_key or key, [label], measure, True)
    return _ordered(totals, measure_alias(measure), [label], n, bottom)


def top_n_denormalized(view: DataFrame, label: str, measure: str, n: int | None = 5, bottom=False) -> DataFrame:
    """Ranking on the wide view, grouped by a name column."""
    value = F.count(F.lit(1)) if measure == COUNT else F.sum(measure)
    totals = view.groupBy(label).agg(value.alias(measure_alias(measure)))
    return _ordered(totals, measure_alias(measure), [label], n, bottom)


def distinct_buyers(
    sales: DataFrame, by: str | Sequence[str] | None = None, customer: str = "customer_id", approx: bool = False
) -> DataFrame:
    """Number of different buyers, overall or per group; ``approx`` uses a sketch."""
    keys = [by] if isinstance(by, str) else list(by or [])
    if approx:
        return sales.groupBy(*keys).agg(F.approx_count_distinct(customer).alias("buyers"))
    pairs = sales.select(*keys, customer).distinct()
    return pairs.groupBy(*keys).agg(F.count(customer).alias("buyers"))


def dimension_totals(fact: DataFrame, keys: Sequence[str], measure: str = "total_sales_value") -> DataFrame:
    """(dimension, total, unknown, members) per foreign key: all of the measure, what of it has no member, and the members.

    One pass; each key is first summed per member.  ``total`` is the same in every row, because no column that
    is asked for adds or drops rows of the fact.
    """
    sums = fact.groupingSets([[k] for k in keys], *keys).agg(
        F.sum(measure).alias("v"), *[F.grouping(k).alias(f"without_{k}") for k in keys]
    )
    dimension = F.coalesce(*[F.when(F.col(f"without_{k}") == 0, F.lit(k)) for k in keys])
    known = F.coalesce(*[F.when((F.col(f"without_{k}") == 0) & F.col(k).isNotNull(), F.lit(1)) for k in keys])
    return sums.select(dimension.alias("dimension"), "v", known.alias("known")).groupBy("dimension").agg(
        F.sum("v").alias("total"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("v"))), F.lit(0.0)).alias("unknown"),
        F.count("known").alias("members"),
    )
