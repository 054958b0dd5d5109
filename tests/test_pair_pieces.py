"""Item pairs are counted in pieces whose number follows the pairs, not the session."""

from collections import Counter
from itertools import combinations

from starlens.operators import analytics as an


def test_pieces_follow_the_pairs(spark, monkeypatch):
    held = [range(b, b + 10) for b in range(40)]
    rows = spark.createDataFrame([(b, i, 10) for b, its in enumerate(held) for i in its], "basket bigint, item bigint, size bigint")
    few = an._met(rows, 256).rdd.getNumPartitions()
    monkeypatch.setattr(an, "PAIRS_PER_PIECE", 20)
    met = an._met(rows, 256)
    assert few == spark.sparkContext.defaultParallelism and met.rdd.getNumPartitions() == 40 * 45 // 20
    want = Counter(p for its in held for p in combinations(its, 2))
    assert {tuple(r) for r in met.collect()} == {(a, b, n) for (a, b), n in want.items()}
