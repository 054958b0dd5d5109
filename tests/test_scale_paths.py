"""The ways taken only by large or skewed data, forced on small fixtures and compared by brute force."""

import random
from collections import Counter
from itertools import combinations
from statistics import median

import pytest
from pyspark.sql import functions as F

from starlens.functions.stats import exact_median, global_rank
from starlens.joins import lookup_join
from starlens.operators import analytics as an
from starlens.operators import patterns as pat
from starlens.operators.answers import resolve_mentions


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    rng = random.Random(1)
    big = spark.createDataFrame(
        [(0 if i % 3 == 0 else rng.randrange(50), i) for i in range(900)], "k bigint, v bigint"
    )
    lookup = spark.createDataFrame([(k, f"name {k}") for k in range(0, 40)], "k bigint, name string")
    plain = sorted(map(tuple, big.join(lookup, "k", how).collect()), key=str)
    salted = lookup_join(big, lookup, "k", how, limit=-1, salts=4)
    assert sorted(map(tuple, salted.collect()), key=str) == plain
    assert salted.columns == big.join(lookup, "k", how).columns


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0] * 10 + [1.0, 9.0], list(range(1, 1001)), [0.0] * 500 + list(range(501))])
def test_exact_median(spark, values):
    values = [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    assert exact_median(df, "v").first()["median"] == median(values)


def test_exact_median_random(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(20_001)] + [0.25] * 9_000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_median(df, "v").first()["median"] == median(values)


def test_median_ranks_few_rows(spark, monkeypatch):
    """With the first bracket as wide as the table, the second leaves a few steps of it."""
    from starlens.functions import stats

    monkeypatch.setattr(stats, "_MARGIN", 0.5)
    rng = random.Random(8)
    for values in ([rng.expovariate(1) for _ in range(30_000)], [float(rng.randrange(40)) for _ in range(5_001)]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        found = exact_median(df, "v")
        assert found.first()["median"] == median(values)
    ranked = []
    bracket = stats._bracket

    def watched(data, bounds):
        ranked.append(bracket(data, bounds))
        return ranked[-1]

    monkeypatch.setattr(stats, "_bracket", watched)
    exact_median(spark.range(100_000).select(F.col("id").cast("double").alias("v")), "v")
    assert ranked[0][0].count() >= 99_999 and ranked[1][0].count() <= 700


@pytest.mark.parametrize("dense", [False, True])
def test_global_rank(spark, dense):
    rng = random.Random(3)
    values = [5 if i % 3 == 0 else rng.randrange(400) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v bigint")
    got = {r["id"]: r["rk"] for r in global_rank(df, "v", "rk", dense).collect()}
    ordered = sorted(set(values), reverse=True) if dense else sorted(values, reverse=True)
    first = {}
    for place, v in enumerate(ordered, 1):
        first.setdefault(v, place)
    assert got == {i: first[v] for i, v in enumerate(values)}


def baskets():
    rng = random.Random(11)
    rows = [(b, rng.randrange(30)) for b in range(120) for _ in range(rng.randrange(1, 5))]
    # Three baskets that hold far more than the rest, with items that appear nowhere else.
    for b, span in ((900, range(0, 70)), (901, range(20, 80)), (902, range(40, 90))):
        rows += [(b, i) for i in span]
    return rows


@pytest.mark.parametrize("min_support", [1, 2, 3])
def test_bought_together_with_large_baskets(spark, min_support):
    held = {}
    for b, i in baskets():
        held.setdefault(b, set()).add(i)
    support = Counter(i for its in held.values() for i in its)
    pairs = Counter(p for its in held.values() for p in combinations(sorted(its), 2))
    want = {
        (a, b, n, round(n / support[a], 6), round(n * len(held) / (support[a] * support[b]), 6))
        for (a, b), n in pairs.items()
        if n >= min_support
    }
    sales = spark.createDataFrame([*baskets(), (None, 3), (4, None)], "order_id bigint, item_id bigint")
    for block, direct in ((8, 0), (256, 0), (8, 1000)):
        got = an.bought_together(sales, min_support, block=block, direct=direct).collect()
        assert len(got) == len(want)
        assert {(r[0], r[1], r[2], round(r[3], 6), round(r[4], 6)) for r in got} == want


def test_two_different_items(spark):
    items = spark.createDataFrame([(1, "red plate"), (2, "red ring")], "item_id bigint, item_name string")
    customers = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "customer_id bigint, customer_name string")
    sales = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (3, 2)], "customer_id bigint, item_id bigint")
    args = (sales, items, customers, "red plate", "red")
    both = pat.customers_who_bought_both(*args)
    two = pat.customers_who_bought_both(*args, distinct_items=True)
    assert {r[0] for r in both.collect()} == {1, 2}
    assert {r[0] for r in two.collect()} == {2}


def test_mentions_by_substring(spark):
    items = spark.createDataFrame(
        [(3, "Red Plate"), (1, "small red"), (7, "blue bolt"), (9, None)], "item_id bigint, item_name string"
    )
    asked = ["RED", "plate", "7", "d P", "nothing", "red plate"]
    mentions = spark.createDataFrame([(m,) for m in asked], "mention string")
    got = {r["mention"]: r["first_item"] for r in resolve_mentions(mentions, items).collect()}
    assert got == {"red": 1, "plate": 3, "7": 7, "d p": 3, "nothing": None, "red plate": 3}


def test_approximate_buyers(spark):
    from starlens.operators.aggregates import distinct_buyers

    sales = spark.range(5000).select((F.col("id") % 700).alias("customer_id"), (F.col("id") % 2).alias("item_id"))
    assert distinct_buyers(sales).first()[0] == 700
    assert abs(distinct_buyers(sales, approx=True).first()[0] - 700) < 70


def test_salts_shrink_with_the_lookup():
    from starlens.joins import COPIED_BYTES, SALTS, salts_for

    assert salts_for(None) == SALTS and salts_for(1 << 20) == SALTS
    assert salts_for(COPIED_BYTES // 4) == 4
    assert salts_for(COPIED_BYTES * 100) == 1


def test_walk_and_patterns_without_broadcast(spark, monkeypatch):
    """The salted joins inside the operators give the broadcast ones' rows."""
    from starlens import joins
    from starlens.operators import graph as gr

    rng = random.Random(2)
    fact = spark.createDataFrame(
        [(0 if i % 3 == 0 else rng.randrange(60), rng.randrange(40)) for i in range(600)],
        "customer_id bigint, item_id bigint",
    )
    items = spark.createDataFrame([(i, f"{'red' if i % 5 else 'blue'} {i}") for i in range(40)], "item_id bigint, item_name string")
    customers = spark.createDataFrame([(i, f"c{i}") for i in range(60)], "customer_id bigint, customer_name string")
    mapping = {"item_id": "item", "customer_id": "customer"}
    seeds = spark.createDataFrame([("customer_0",)], "node_id string")

    def results():
        edges = gr.build_edges(fact, mapping, {"item": items.filter("item_id < 30")})
        walk = gr.expand_context(gr.adjacency(edges), seeds, 2)
        return [
            sorted(map(tuple, walk.collect())),
            gr.subgraph_size(edges, walk).collect(),
            sorted(map(tuple, pat.customers_who_bought(fact, items, customers, "blue").collect())),
            pat.pair_support(fact, items, "blue", "red 1").collect(),
        ]

    plain = results()
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(joins.lookup_join, "__defaults__", ("inner", -1, None))
    assert results() == plain


def test_large_baskets_propose_few_pairs(spark):
    """Fifty baskets of all 400 items and some small ones: pairs are formed in the small baskets only."""
    rows = [(b, i) for b in range(50) for i in range(400)] + [(100 + i // 4, i) for i in range(400)]
    kept = spark.createDataFrame(rows, "basket bigint, item bigint")
    kept = kept.join(kept.groupBy("basket").agg(F.count("*").alias("size")), "basket")
    assert an._met(kept, 64).agg(F.sum("met")).first()[0] == 50 * 400 * 399 // 2 + 100 * 6
    often = an._met_often(kept, 51, 64)
    assert often.count() == 100 * 6 and often.filter("met <> 51").isEmpty()
