"""Pairs of items that share crowded baskets are counted in blocks, and none is shuffled."""

import random
from collections import Counter
from itertools import combinations

import pytest

from starlens.operators import analytics as an


def held(make):
    rng = random.Random(6)
    rows = [(b, make(i)) for b in range(30) for i in range(150) if rng.random() < 0.8]
    rows += [(100 + rng.randrange(60), make(rng.randrange(170))) for _ in range(900)]
    return [*rows, *rows[:50]]


def pairs(rows):
    baskets = {}
    for b, i in rows:
        baskets.setdefault(b, set()).add(i)
    support = Counter(i for its in baskets.values() for i in its)
    met = Counter(p for its in baskets.values() for p in combinations(sorted(its), 2))
    return {(a, b, n, n / support[a], n * len(baskets) / (support[a] * support[b])) for (a, b), n in met.items()}


@pytest.mark.parametrize("kind, make", [("bigint", lambda i: 7 * i), ("string", lambda i: f"s{i % 13}é{i}")])
@pytest.mark.parametrize("min_support", [1, 12])
def test_blocks_of_items(spark, monkeypatch, kind, make, min_support):
    for name, n in (("SMALL_BLOCK", 8), ("STRIP", 5), ("PAIRS_PER_BATCH", 20), ("BASKETS_PER_PRODUCT", 4)):
        monkeypatch.setattr(an, name, n)
    rows = held(make)
    sales = spark.createDataFrame([*rows, (None, make(1)), (1, None)], f"order_id bigint, item_id {kind}")
    want = {p for p in pairs(rows) if p[2] >= min_support}
    got = an.bought_together(sales, min_support, direct=8, items=40)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_no_pair_is_shuffled(spark):
    rows = [(b, i) for b in range(30) for i in range(300)]
    plan = an.bought_together(spark.createDataFrame(rows, "order_id bigint, item_id bigint"), 12)._jdf.queryExecution().executedPlan()
    above = plan.toString().split("MapInArrow")
    # The number of baskets is a subquery above, which is shuffled by basket.
    assert len(above) == 2 and "hashpartitioning(item" not in above[0] and "Join" not in above[0]


def test_few_copies_or_the_old_ways(spark):
    """One huge basket and small ones: the items propose little, so their rows are not copied for each block."""
    rows = [(0, i) for i in range(600)] + [(1 + i // 3, i) for i in range(600)]
    sales = spark.createDataFrame(rows, "order_id bigint, item_id bigint")
    got = an.bought_together(sales, 2, direct=8, items=4)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[:3] for r in got.collect()} == {(3 * j + a, 3 * j + b, 2) for j in range(200) for a, b in ((0, 1), (0, 2), (1, 2))}
