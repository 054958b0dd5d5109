"""Deeper analytics over the fact.  (G1-G30)

Each starts with a per-entity aggregate that combines map-side.  Totals, means and medians enter as
scalar subqueries, which run once and reuse the shuffle of the per-entity aggregate, so nothing is
joined with a one-row table and no window spans the whole result.  Windows run only over
pre-aggregated period rows of one entity, whose number the calendar bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.functions.stats import exact_median, global_rank
from starlens.joins import MOST_PIECES, SALTS, dealt, lookup_join
from starlens.session import cut_lineage

VALUE = "total_sales_value"
UNITS = "units_sold"


def _keys(key: str | Sequence[str] | None) -> list[str]:
    return [key] if isinstance(key, str) else list(key or [])


def _top(df: DataFrame, order: Column, ties: Sequence[str], n: int | None) -> DataFrame:
    out = df.orderBy(order, *ties)
    return out if n is None else out.limit(n)


def total_per(sales: DataFrame, key: str | Sequence[str], value: str = VALUE, name: str = "total") -> DataFrame:
    return sales.groupBy(*_keys(key)).agg(F.sum(value).alias(name))


def ratio_per_key(sales: DataFrame, key: str, num: str = VALUE, den: str = UNITS) -> DataFrame:
    return sales.groupBy(key).agg(F.try_divide(F.sum(num), F.sum(den)).alias("ratio"))


# -- comparison with the mean, a multiple of it, or the median ---------------------------------


def above_average_ratio(sales: DataFrame, key: str, num: str = VALUE, den: str = UNITS) -> DataFrame:
    """G1: entities whose ratio of sums exceeds the mean ratio over all entities."""
    ratios = ratio_per_key(sales, key, num, den)
    return ratios.filter(F.col("ratio") > ratios.agg(F.avg("ratio")).scalar())


def above_average(sales: DataFrame, key: str, value: str = VALUE, factor: float = 1.0) -> DataFrame:
    """Entities whose total exceeds ``factor`` times the mean total."""
    totals = total_per(sales, key, value)
    return totals.filter(F.col("total") > F.lit(factor) * totals.agg(F.avg("total")).scalar())


def revenue_over_k_avg(sales: DataFrame, k: float, key: str = "item_id", value: str = VALUE) -> DataFrame:
    """Entities with more than ``k`` times the mean total."""
    return above_average(sales, key, value, k)


def below_average(sales: DataFrame, key: str, value: str = VALUE) -> DataFrame:
    """Entities below the mean total."""
    totals = total_per(sales, key, value)
    return totals.filter(F.col("total") < totals.agg(F.avg("total")).scalar())


def above_median(sales: DataFrame, key: str, value: str = VALUE) -> DataFrame:
    """Entities above the exact median total."""
    totals = total_per(sales, key, value)
    return totals.filter(F.col("total") > exact_median(totals, "total").scalar())


def frequency_above_median(sales: DataFrame, key: str = "customer_id", order: str = "order_id") -> DataFrame:
    """Customers with more orders than the median customer."""
    orders = count_distinct_per(sales, key, order, "orders")
    return orders.filter(F.col("orders") > exact_median(orders, "orders").scalar())


def contribution_pct(sales: DataFrame, key: str, value: str = VALUE) -> DataFrame:
    """Share of each entity in the overall total, in percent."""
    totals = total_per(sales, key, value)
    whole = totals.agg(F.sum("total")).scalar()
    return totals.withColumn("contribution_pct", F.try_divide(F.lit(100.0) * F.col("total"), whole))


# -- distinct counts, division, exclusion --------------------------------------------------------


def count_distinct_per(sales: DataFrame, key: str, counted: str, name: str) -> DataFrame:
    """Distinct values per key in two steps, so a hot key is spread over its values first."""
    return sales.select(key, counted).distinct().groupBy(key).agg(F.count(counted).alias(name))


def buyers_in_n_locations(
    sales: DataFrame, n: int, customer: str = "customer_id", location: str = "location_id"
) -> DataFrame:
    """Customers who bought in at least ``n`` different locations."""
    return count_distinct_per(sales, customer, location, "locations").filter(F.col("locations") >= n)


def sold_everywhere(sales: DataFrame, dim: DataFrame, location: str, item: str = "item_id") -> DataFrame:
    """Items sold in every member of a dimension (relational division)."""
    members = dim.select(location).distinct()
    pairs = lookup_join(sales.select(item, location).distinct(), members, location, "left_semi", salts=SALTS)
    covered = pairs.groupBy(item).agg(F.count(location).alias("locations"))
    return covered.filter(F.col("locations") == members.agg(F.count(F.lit(1))).scalar())


def popular_in_not_in(
    sales: DataFrame, x, y, item: str = "item_id", location: str = "location_id", units: str = UNITS
) -> DataFrame:
    """Items above location x's mean units per item, and not above location y's."""
    here = sales.filter(F.col(location).isin(x, y))
    per_item = here.groupBy(item).agg(
        F.sum(F.when(F.col(location) == x, F.col(units))).alias("units_x"),
        F.sum(F.when(F.col(location) == y, F.col(units))).alias("units_y"),
    )
    mean_x = per_item.agg(F.avg("units_x")).scalar()
    mean_y = per_item.agg(F.avg("units_y")).scalar()
    popular_y = F.coalesce(F.col("units_y") > mean_y, F.lit(False))
    return per_item.filter((F.col("units_x") > mean_x) & ~popular_y).select(item, "units_x")


def only_bought_above(
    sales: DataFrame, price: float, customer: str = "customer_id", value: str = VALUE, units: str = UNITS
) -> DataFrame:
    """Customers all of whose purchases had a unit price above ``price``."""
    unit_price = F.try_divide(F.col(value), F.col(units))
    lowest = sales.groupBy(customer).agg(F.min(unit_price).alias("lowest_price"))
    return lowest.filter(F.col("lowest_price") > price)


# -- time ----------------------------------------------------------------------------------------


def avg_days_between(
    sales: DataFrame, customer: str = "customer_id", date: str = "sale_date"
) -> DataFrame:
    """Mean number of days between consecutive purchase days of a customer.

    The gaps of an ordered series add up to last minus first, so no ordering is needed.
    """
    days = sales.select(customer, F.to_date(date).alias("day")).distinct()
    span = days.groupBy(customer).agg(
        F.count("day").alias("purchase_days"),
        F.datediff(F.max("day"), F.min("day")).alias("span"),
    )
    return span.filter("purchase_days >= 2").select(
        customer, "purchase_days", (F.col("span") / (F.col("purchase_days") - 1)).alias("avg_days")
    )


def purchase_interval(
    sales: DataFrame, customer: str = "customer_id", order: str = "order_id", date: str = "sale_date"
) -> DataFrame:
    """First and last day, orders, span, and orders per 30 days of each customer."""
    orders = sales.groupBy(customer, order).agg(F.min(date).alias("d0"), F.max(date).alias("d1"))
    out = orders.groupBy(customer).agg(
        F.to_date(F.min("d0")).alias("first_day"),
        F.to_date(F.max("d1")).alias("last_day"),
        F.count(F.lit(1)).alias("orders"),
    )
    span = F.datediff("last_day", "first_day").cast("bigint")
    return out.withColumn("span_days", span).withColumn(
        "orders_per_30_days", F.try_divide(F.col("orders") * F.lit(30.0), F.col("span_days"))
    )


def period_totals(
    sales: DataFrame,
    period: str,
    keys: str | Sequence[str] | None = None,
    value: str = VALUE,
    date: str = "sale_date",
) -> DataFrame:
    """Totals per key and calendar period; ``period`` is the first day of the period."""
    start = F.to_date(F.date_trunc(period, F.col(date)))
    return sales.groupBy(*_keys(keys), start.alias("period")).agg(F.sum(value).alias("total"))


def period_trend(
    sales: DataFrame,
    period: str,
    keys: str | Sequence[str] | None = None,
    value: str = VALUE,
    date: str = "sale_date",
) -> DataFrame:
    """Totals per period with the previous period's total and the relative growth."""
    series = period_totals(sales, period, keys, value, date)
    order = Window.partitionBy(*_keys(keys)).orderBy("period")
    series = series.withColumn("previous", F.lag("total").over(order))
    growth = F.try_divide(F.col("total") - F.col("previous"), F.col("previous"))
    return series.withColumn("growth", growth)


def mom_growth(
    sales: DataFrame, keys: str | Sequence[str] | None = None, condition: Column | None = None, **columns
) -> DataFrame:
    """Month-over-month growth of the rows that meet ``condition``."""
    return period_trend(sales if condition is None else sales.filter(condition), "month", keys, **columns)


def trend_slope(
    sales: DataFrame, key: str, period: str = "year", value: str = VALUE, date: str = "sale_date"
) -> DataFrame:
    """Least-squares slope of the period totals of each entity, per period step."""
    series = period_totals(sales, period, key, value, date)
    months = (F.year("period") - 2000) * 12 + F.month("period") - 1
    steps = {"year": 12, "quarter": 3, "month": 1}[period.lower()]
    return series.groupBy(key).agg(
        F.count(F.lit(1)).alias("periods"),
        F.regr_slope("total", (months / F.lit(steps)).cast("double")).alias("slope"),
    )


def declining(
    sales: DataFrame, period: str, k: int = 3, key: str = "item_id", value: str = VALUE, date: str = "sale_date"
) -> DataFrame:
    """Entities whose totals fell strictly over their last ``k`` periods with sales."""
    series = period_totals(sales, period, key, value, date)
    order = Window.partitionBy(key).orderBy("period")
    back = [F.lag("total", i).over(order).alias(f"p{i}") for i in range(1, k)]
    last = series.select("*", F.lead("period").over(order).alias("later"), *back).filter("later IS NULL")
    chain = ["total", *[f"p{i}" for i in range(1, k)]]
    falling = F.lit(True)
    for newer, older in zip(chain, chain[1:]):
        falling = falling & (F.col(newer) < F.col(older))
    return last.filter(falling).select(key, "period", F.col("total").alias("latest"))


# -- baskets -------------------------------------------------------------------------------------


def avg_basket_value(
    sales: DataFrame, n: int | None = 10, customer: str = "customer_id", order: str = "order_id", value: str = VALUE
) -> DataFrame:
    """Customers by mean value of an order."""
    orders = sales.groupBy(customer, order).agg(F.sum(value).alias("v"))
    means = orders.groupBy(customer).agg(F.avg("v").alias("avg_order_value"))
    return _top(means, F.desc("avg_order_value"), [customer], n)


#: Members of one block of a basket; the items of two blocks meet in one group.
BASKET_BLOCK = 256
#: Partners of a row in its basket, on average, up to which all pairs are formed.
DIRECT_PARTNERS = 64
#: Pairs of items that one task counts, and rows of baskets that one task joins.
PAIRS_PER_PIECE = 1 << 19
ROWS_PER_PIECE = 1 << 18


def _met(rows: DataFrame, block: int) -> DataFrame:
    """Item pairs and the baskets in which both stand in ``rows`` (basket, item, size), counted: (item_a, item_b, met).

    A basket is cut into blocks by a hash of the item, and a group holds two blocks of one basket, so the work of a
    large basket spreads over many groups of bounded size.
    """
    blocks = F.ceil(F.col("size") / block)
    cut = rows.select("basket", "item", blocks.alias("blocks"), F.pmod(F.xxhash64("item"), blocks).alias("own"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    left = cut.select("basket", F.col("item").alias("item_a"), F.col("own").alias("block_a"), every.alias("block_b"))
    right = cut.select("basket", F.col("item").alias("item_b"), every.alias("block_a"), F.col("own").alias("block_b"))
    # Most pairs meet once: they are counted after the shuffle only. Both shuffles have pieces of bounded size.
    size = rows.agg(F.sum(blocks).alias("rows"), F.sum(F.col("size") - 1).alias("partners")).first()
    met = ("basket", "block_a", "block_b")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    dealt_out, pieces = (
        min(max(-(-(n or 0) // most), cores), MOST_PIECES)
        for n, most in ((size["rows"], ROWS_PER_PIECE), (size["partners"], 2 * PAIRS_PER_PIECE))
    )
    left, right = (side.repartition(dealt_out, *met) for side in (left, right))
    pairs = left.join(right, [*met]).filter("item_a < item_b").repartition(pieces, "item_a", "item_b")
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("met"))


def _proposing(kept: DataFrame, min_support: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in which an item proposes pairs, its last ``min_support - 1`` rows, and the place where it stops proposing.

    Baskets are ordered by size.  Two items that share enough baskets share one that is not among the last
    ``min_support - 1`` of either, so items propose pairs only from their other, smaller baskets.
    """
    place = F.struct("size", "basket")
    largest = Window.partitionBy("item").orderBy(F.desc("size"), F.desc("basket"))
    last = cut_lineage(kept.withColumn("r", F.row_number().over(largest)).filter(F.col("r") < min_support).drop("r"))
    stops = last.groupBy("item").agg(F.min(place).alias("stop"))
    return lookup_join(kept, stops, "item", salts=SALTS).filter(place < F.col("stop")), last, stops


def _met_often(
    kept: DataFrame, min_support: int, block: int, proposed: tuple[DataFrame, DataFrame, DataFrame] | None = None
) -> DataFrame:
    """:func:`_met` for the pairs that may share ``min_support`` baskets, without forming the others of large baskets.

    A pair's count is the number of baskets in which both propose (:func:`_proposing`), plus what it has in the last ones
    of the item that stops proposing first: those are at most ``min_support - 1`` rows, which are looked up.
    """
    proposing, last, stops = proposed or _proposing(kept, min_support)
    pairs = _met(proposing, block)
    for end in ("a", "b"):
        stop = stops.select(F.col("item").alias(f"item_{end}"), F.col("stop").alias(f"stop_{end}"))
        pairs = lookup_join(pairs, stop, f"item_{end}", salts=SALTS)
    first = F.col("stop_a") <= F.col("stop_b")
    asked = pairs.select(
        "item_a",
        "item_b",
        "met",
        F.when(first, F.col("item_a")).otherwise(F.col("item_b")).alias("item"),
        F.when(first, F.col("item_b")).otherwise(F.col("item_a")).alias("other"),
    )
    asked = lookup_join(asked, last.select("item", "basket"), "item", salts=SALTS)
    holds = kept.select(F.col("item").alias("other"), "basket", F.lit(1).alias("held"))
    found = asked.join(holds, ["other", "basket"], "left").groupBy("item_a", "item_b")
    return found.agg((F.max("met") + F.count("held")).alias("met"))


#: Items of a block at most, and at least while some cores would have no pair of blocks to count.
ITEM_BLOCK = 4096
SMALL_BLOCK = 256
#: Rows of a block that are counted at once against another, pairs in a batch, and the filled share of two blocks' cells
#: from which a basket is counted by a product of matrices, of so many baskets each.
STRIP = 1024
PAIRS_PER_BATCH = 1 << 18
FILLED = 1 / 64
BASKETS_PER_PRODUCT = 1024


def _by_basket(baskets: np.ndarray, members: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Members in the order of their baskets (numbers below ``n``), and where each basket starts and ends."""
    order = np.argsort(baskets, kind="stable")
    return members[order], np.concatenate([[0], np.cumsum(np.bincount(baskets, minlength=n))])


def _counts(left: tuple, right: tuple, rows: int, columns: int) -> np.ndarray:
    """Common baskets of ``rows`` items of one block with ``columns`` items of another, each as :func:`_by_basket` gives them."""
    met = np.zeros((rows, columns), np.int32)
    (a, a_ends), (b, b_ends) = left, right
    cells = np.diff(a_ends) * np.diff(b_ends)
    filled = cells >= FILLED * rows * columns
    full = np.flatnonzero(filled & (cells > 0))
    for at in range(0, len(full), BASKETS_PER_PRODUCT):
        some = full[at : at + BASKETS_PER_PRODUCT]
        sides = []
        for members, ends, n in ((a, a_ends, rows), (b, b_ends, columns)):
            side = np.zeros((n, len(some)), np.float32)
            for i, basket in enumerate(some):
                side[members[ends[basket] : ends[basket + 1]], i] = 1
            sides.append(side)
        met += (sides[0] @ sides[1].T).astype(np.int32)
    for basket in np.flatnonzero(~filled & (cells > 0)):
        met[np.ix_(a[a_ends[basket] : a_ends[basket + 1]], b[b_ends[basket] : b_ends[basket + 1]])] += 1
    return met


def _pairs_of_blocks(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y, met, support_x, support_y) of two blocks, or inside one, that share at least ``least`` baskets."""
    first, own = (rows.column(c).to_numpy() for c in ("first", "own"))
    item, support, held = (rows.column(c).combine_chunks() for c in ("item", "support", "held"))
    sizes = held.value_lengths().to_numpy()
    _, baskets = np.unique(held.flatten().to_numpy(), return_inverse=True)
    n = int(baskets.max(initial=-1)) + 1
    holder = np.repeat(np.arange(len(own)), sizes)
    left, right = np.flatnonzero(own == first), np.flatnonzero(own != first)
    inside = not len(right) and rows.column("last")[0].as_py() == first[0]
    if inside:
        right = left
    place = np.empty(len(own), np.int64)
    place[right] = np.arange(len(right))
    mine = np.isin(holder, right)
    others = _by_basket(baskets[mine], place[holder[mine]], n)
    at_once = max(1, PAIRS_PER_BATCH // max(1, len(right)))
    for start in range(0, len(left), STRIP):
        strip = left[start : start + STRIP]
        place[strip] = np.arange(len(strip))
        mine = np.isin(holder, strip)
        met = _counts(_by_basket(baskets[mine], place[holder[mine]], n), others, len(strip), len(right))
        for some in range(0, len(strip), at_once):
            enough = met[some : some + at_once] >= least
            if inside:  # each pair once
                enough &= np.arange(len(right)) > np.arange(start + some, start + some + len(enough))[:, None]
            row, column = np.divmod(np.flatnonzero(enough), len(right))
            if not len(row):
                continue
            ends = [pa.array(strip[some + row]), pa.array(right[column])]
            columns = [*(item.take(e) for e in ends), pa.array(met[some + row, column].astype(np.int64)), *(support.take(e) for e in ends)]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "met", "support_x", "support_y"])


def _met_in_blocks(kept: DataFrame, frequent: DataFrame, min_support: int, most: int) -> DataFrame:
    """Pairs that share ``min_support`` baskets, with the support of both: (item_a, item_b, met, support_a, support_b).

    Items are cut into blocks of at most about ``most`` by a hash, and an item's row with all its baskets is copied once for each
    block: two blocks are one task's work, which counts their pairs and gives those that are wanted.  No pair is shuffled.
    """
    cores = kept.sparkSession.sparkContext.defaultParallelism
    n = frequent.count()
    blocks = max(1, -(-n // most), min(-(-n // SMALL_BLOCK), math.isqrt(4 * cores) + 1))
    baskets = kept.select("basket").distinct().withColumn("number", F.monotonically_increasing_id())
    held = lookup_join(kept.select("basket", "item"), cut_lineage(baskets), "basket", salts=SALTS)
    held = held.groupBy("item").agg(F.collect_list("number").alias("held"))
    held = lookup_join(held, frequent.select("item", "support"), "item", salts=SALTS)
    own = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    copies = held.select("item", "support", "held", own.alias("own"), every.alias("other"))
    copies = copies.withColumns({"first": F.least("own", "other"), "last": F.greatest("own", "other")})
    place = (F.col("last") * (F.col("last") + 1).cast("bigint") / 2).cast("bigint") + F.col("first")
    pieces = min(blocks * (blocks + 1) // 2, MOST_PIECES)
    copies = copies.withColumn("place", place).withColumn("piece", F.pmod("place", F.lit(pieces)).cast("int"))
    copies = copies.repartitionById(pieces, F.col("piece")).sortWithinPartitions("place").drop("piece", "other")
    least = max(min_support, 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = [], None
        for batch in batches:
            places = batch.column(batch.schema.get_field_index("place")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(places)) + 1), len(places)]
            for start, stop in zip(cuts, cuts[1:]):
                if rows and places[start] != at:
                    yield from _pairs_of_blocks(pa.Table.from_batches(rows), least)
                    rows = []
                if stop > start:
                    at = places[start]
                    rows.append(batch.slice(start, stop - start))
        if rows:
            yield from _pairs_of_blocks(pa.Table.from_batches(rows), least)

    kind = kept.schema["item"].dataType.simpleString()
    pairs = copies.mapInArrow(counted, f"x {kind}, y {kind}, met bigint, support_x bigint, support_y bigint")
    ordered = F.col("x") < F.col("y")
    return pairs.select(
        F.least("x", "y").alias("item_a"),
        F.greatest("x", "y").alias("item_b"),
        "met",
        F.when(ordered, F.col("support_x")).otherwise(F.col("support_y")).alias("support_a"),
        F.when(ordered, F.col("support_y")).otherwise(F.col("support_x")).alias("support_b"),
    )


def bought_together(
    sales: DataFrame,
    min_support: int,
    basket: str = "order_id",
    item: str = "item_id",
    block: int = BASKET_BLOCK,
    direct: int = DIRECT_PARTNERS,
    items: int = ITEM_BLOCK,
) -> DataFrame:
    """Item pairs that share at least ``min_support`` baskets, with confidence and lift; exact for any basket size.

    Rows without basket or item are left out.  All pairs of a basket are formed while a row has at most ``direct``
    partners on average, which keeps the work in proportion to the rows; else the largest baskets of an item
    propose nothing (:func:`_met_often`).  Where that leaves a row more than ``direct`` partners still, and more pairs than
    copies of all rows for each block of ``items`` items, pairs are counted in place (:func:`_met_in_blocks`).  Every way gives the
    same pairs and counts.
    """
    rows = sales.select(F.col(basket).alias("basket"), F.col(item).alias("item")).na.drop()
    rows = dealt(rows, "basket", "item").distinct()
    baskets = rows.select("basket").distinct().agg(F.count(F.lit(1))).scalar()
    support = rows.groupBy("item").agg(F.count(F.lit(1)).alias("support"))
    frequent = cut_lineage(support.filter(F.col("support") >= min_support))
    kept = lookup_join(rows, frequent.select("item"), "item", "left_semi", salts=SALTS)
    sizes = kept.groupBy("basket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    kept = cut_lineage(lookup_join(kept, sizes, "basket", salts=SALTS))
    crowd, n_rows = kept.agg(F.avg(F.col("size") - 1), F.count(F.lit(1))).first()
    crowd, proposed = crowd or 0, None
    if crowd > direct:
        n_proposed = crowd * n_rows / 2
        if min_support >= 2:
            proposed = _proposing(kept, min_support)
            held = proposed[0].groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
            n_proposed = held.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        crowded = n_proposed > direct * n_rows / 2 and n_proposed >= n_rows * -(-frequent.count() // items)
    if crowd > direct and crowded:
        out = _met_in_blocks(kept, frequent, min_support, items)
    else:
        pairs = _met(kept, block) if min_support < 2 or crowd <= direct else _met_often(kept, min_support, block, proposed)
        out = pairs.filter(F.col("met") >= min_support)
        for end in ("a", "b"):
            known = frequent.select(F.col("item").alias(f"item_{end}"), F.col("support").alias(f"support_{end}"))
            out = lookup_join(out, known, f"item_{end}", salts=SALTS)
    return out.select(
        "item_a",
        "item_b",
        F.col("met").alias("support"),
        (F.col("met") / F.col("support_a")).alias("confidence"),
        (F.col("met") * baskets / (F.col("support_a") * F.col("support_b"))).alias("lift"),
    )


# -- location comparisons ------------------------------------------------------------------------


def location_dominance(
    sales: DataFrame, at, k: float = 2.0, item: str = "item_id", location: str = "location_id", value: str = VALUE
) -> DataFrame:
    """Items whose total at one location exceeds ``k`` times the mean of its other locations."""
    cells = sales.groupBy(item, location).agg(F.sum(value).alias("v"))
    per_item = cells.groupBy(item).agg(
        F.sum(F.when(F.col(location) == at, F.col("v"))).alias("own"),
        F.sum(F.when(F.col(location) != at, F.col("v"))).alias("rest"),
        F.count_if(F.col(location) != at).alias("others"),
    )
    out = per_item.withColumn("avg_others", F.try_divide("rest", "others"))
    return out.filter(F.col("own") > F.lit(k) * F.col("avg_others")).select(item, "own", "avg_others")


def compare_locations(
    sales: DataFrame, x, y, item: str = "item_id", location: str = "location_id", value: str = VALUE
) -> DataFrame:
    """Totals of each item in two locations, their difference and ratio."""
    here = sales.filter(F.col(location).isin(x, y))

    def at(place):
        return F.coalesce(F.sum(F.when(F.col(location) == place, F.col(value))), F.lit(0.0))

    out = here.groupBy(item).agg(at(x).alias("value_x"), at(y).alias("value_y"))
    return out.withColumn("difference", F.col("value_x") - F.col("value_y")).withColumn(
        "ratio", F.try_divide("value_x", "value_y")
    )


def location_ranking(sales: DataFrame, location: str = "location_id", value: str = VALUE) -> DataFrame:
    """Locations with revenue, transactions and dense rank by revenue."""
    totals = sales.groupBy(location).agg(
        F.sum(value).alias("revenue"), F.count(F.lit(1)).alias("transactions")
    )
    return global_rank(totals, "revenue", "revenue_rank", dense=True)


# -- rankings ------------------------------------------------------------------------------------


def top_variance(sales: DataFrame, n: int | None = 10, key: str = "item_id", value: str = VALUE) -> DataFrame:
    """Entities by sample variance of the sale value; at least two sales."""
    stats = sales.groupBy(key).agg(F.count(value).alias("n"), F.var_samp(value).alias("variance"))
    return _top(stats.filter("n >= 2").drop("n"), F.desc("variance"), [key], n)


def most_consistent(
    sales: DataFrame, n: int | None = 10, key: str = "customer_id", value: str = VALUE
) -> DataFrame:
    """Entities by lowest coefficient of variation; at least two purchases."""
    stats = sales.groupBy(key).agg(
        F.count(value).alias("purchases"),
        F.try_divide(F.stddev_samp(value), F.avg(value)).alias("variation"),
    )
    return _top(stats.filter("purchases >= 2"), F.asc("variation"), [key], n)


def lifetime_value(
    sales: DataFrame, customers: DataFrame, n: int | None = None, key: str = "customer_id", value: str = VALUE
) -> DataFrame:
    """Customers by everything they ever bought; value comes from sales alone."""
    totals = total_per(sales, key, value, "lifetime_value").join(customers, key)
    return totals if n is None else _top(totals, F.desc("lifetime_value"), [key], n)


def popularity(sales: DataFrame, key: str = "item_id", units: str = UNITS) -> DataFrame:
    """Transactions and units of each item with its rank by either."""
    totals = sales.groupBy(key).agg(
        F.count(F.lit(1)).alias("transactions"), F.sum(units).alias("units")
    )
    ranked = global_rank(totals, "transactions", "rank_by_transactions")
    return global_rank(ranked, "units", "rank_by_units")


def best_ratio(
    sales: DataFrame, n: int | None = 10, key: str = "item_id", num: str = VALUE, den: str = UNITS
) -> DataFrame:
    """Entities by revenue per unit, the margin stand-in."""
    return _top(ratio_per_key(sales, key, num, den), F.desc("ratio"), [key], n)


def most_loyal(sales: DataFrame, n: int | None = 10, key: str = "customer_id") -> DataFrame:
    """Customers by number of purchases."""
    counts = sales.groupBy(key).agg(F.count(F.lit(1)).alias("purchases"))
    return _top(counts, F.desc("purchases"), [key], n)


# -- groups --------------------------------------------------------------------------------------


def value_within_demographic(
    sales: DataFrame,
    customers: DataFrame,
    column: str,
    keys: Sequence | None = None,
    key: str = "customer_id",
    value: str = VALUE,
) -> DataFrame:
    """Customer value inside chosen demographic groups; the group filters, sales give value."""
    chosen = customers if keys is None else customers.filter(F.col(column).isin(*keys))
    return total_per(sales, key, value, "customer_value").join(chosen, key)


def value_by_demographic(
    sales: DataFrame, customers: DataFrame, column: str, key: str = "customer_id", value: str = VALUE
) -> DataFrame:
    """Customers, total and mean customer value of each demographic group."""
    valued = value_within_demographic(sales, customers, column, None, key, value)
    return valued.groupBy(column).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("customer_value").alias("total_value"),
        F.avg("customer_value").alias("avg_value"),
    )


def ratio_per(sales: DataFrame, key: str, per: str, value: str = VALUE) -> DataFrame:
    """Total of each entity divided by its number of different ``per`` members."""
    cells = sales.groupBy(key, per).agg(F.sum(value).alias("v"))
    out = cells.groupBy(key).agg(F.sum("v").alias("total"), F.count(per).alias("members"))
    return out.withColumn("value_per_member", F.try_divide("total", "members"))
