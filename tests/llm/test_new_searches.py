"""Ranked search, source divergence and exact top-k against brute force, and on awkward input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from starlens.llm import divergence, pivots, term_tree

# Column names that the operators use for themselves.
NOISE = "n long, terms string, bucket long, item string, p long, docs string, v string, gaps string"
EXTRA = (1, "x", 2, "y", 3, "z", "v", "g")
DOCS = [
    (1, None, None, None),
    (2, "", "en", "s"),
    (3, " \n 77 --", "en", "s"),
    (4, "Red red FOX", "en", None),
    (4, "Red red FOX", "en", None),
    (None, "red fox fox fox", "en", "t"),
    (6, "fox " * 40_000, "en", "t"),
    (7, "fox jumps ÄÖ é" + "x" * 30_000, "en", "s"),
    (8, "red fox jumps " + "internationalization " * 3, "en", "t"),
    (9, "einsam", "de", "u"),
    (10, "0 1 2", "fr", "v"),
    (11, "3 4", "fr", "w"),
]
ITEMS = [("a", "red fox, Red!"), ("b", None), ("c", ""), (None, "jumps 77"), ("e", "internationalization"), ("a", "red fox, Red!"), ("z", "absent")]
SCHEMA = "doc_id long, text string, lang string, source string, "


def normal(text, pattern):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(pattern, text or "")]


def ranked(docs, items, ranks=10):
    words = [(i, normal(t, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")) for i, t in docs]
    words = [(i, Counter(w), len(w)) for i, w in words if w]
    n_docs, n_terms = len(words), sum(n for *_, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item, text in items:
        terms = normal(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        scored = []
        for i, c, n in words:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms
                if c[t]
            )
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:ranks], 1)]
    return sorted(out, key=repr)


def test_ranked_search_on_awkward_rows(spark):
    docs = spark.createDataFrame([(*d, *EXTRA) for d in DOCS], SCHEMA + NOISE)
    items = spark.createDataFrame([(*i, *EXTRA) for i in ITEMS], "item_id string, text string, " + NOISE)
    want = ranked([d[:2] for d in DOCS], ITEMS)
    for block_bytes in (1 << 20, 10):
        got = term_tree.ranked_search(docs, items, block_bytes=block_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {r[0] for r in want} == {"a", "e", None}
    assert not term_tree.ranked_search(docs.limit(0), items).collect()
    assert not term_tree.ranked_search(docs, items.limit(0)).collect()


def test_ranked_search_with_copies_and_small_trees(spark, monkeypatch):
    monkeypatch.setattr(term_tree, "LEAF", 3)
    monkeypatch.setattr(term_tree, "LEVELS", 6)
    monkeypatch.setattr(term_tree, "TREE_ENTRIES", 400)
    rnd = random.Random(1)
    word = lambda: f"w{int(rnd.paretovariate(0.7)) % 60}"
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(1, 40)))) for i in range(400)]
    docs += [(1000 - i, docs[7][1]) for i in range(300)]
    items = [(k, " ".join(word() for _ in range(rnd.randrange(1, 12)))) for k in range(25)]
    got = term_tree.ranked_search(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items)


def test_tree_leaves_documents_out():
    rnd = np.random.default_rng(2)
    size, per = 5000, 12
    terms = np.sort(np.argsort(rnd.random((size, 300)) * np.arange(1, 301), axis=1)[:, :per], axis=1).ravel()
    tf = rnd.integers(1, 4, size * per)
    tree = term_tree.Tree(np.arange(size), rnd.integers(50, 200, size), np.full(size, per), terms, tf)
    asked, weights = np.array([0, 3, 150]), np.array([100, 300, 8000])
    best = term_tree.Best(10)
    scored = tree.search(asked, weights, best)
    every = tree.scores(asked, weights, 0, size, False)
    order = np.lexsort((tree.ids, -every))[:10]
    assert best.ids.tolist() == tree.ids[order].tolist() and best.scores.tolist() == every[order].tolist()
    assert scored < size
    for x, (a, b) in enumerate(tree.kids):
        assert a == b or (tree.low[a], tree.high[b - 1]) == (tree.low[x], tree.high[x])
        if a != b:
            bounds = tree.scores(asked, weights, a, b, True)
            assert all(bounds[k - a] >= every[tree.low[k] : tree.high[k]].max() for k in range(a, b))


def diverging(docs, least=3, ranks=200):
    words = [(lang or "", source or "", normal(t, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")) for t, lang, source in docs]
    out = []
    for lang in {w[0] for w in words}:
        mine = [w for w in words if w[0] == lang]
        df = Counter(t for *_, w in mine for t in set(w))
        kept = sorted(t for t in df if df[t] >= least)
        groups = {s: Counter() for _, s, _ in mine}
        for _, s, w in mine:
            groups[s].update(t for t in w if df[t] >= least)
        every = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(every)
        far = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(far(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(found[:most], 1)]
    return sorted(out)


def test_divergence_on_awkward_rows(spark):
    docs = spark.createDataFrame([(*d, *EXTRA) for d in DOCS], SCHEMA + NOISE)
    got = divergence.source_divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, got.collect()))
    assert got == diverging([d[1:] for d in DOCS])
    assert ("fr", "v", "pair", "w", 0, 1) in got
    assert not divergence.source_divergence(docs.limit(0)).collect()


@pytest.mark.parametrize("small", [False, True])
def test_divergence_with_many_sources(spark, monkeypatch, small):
    if small:
        for name, value in (("BUCKET_ROWS", 50), ("SOURCES", 3), ("_CELLS", 40), ("HELD_RUNS", 60), ("PIECE_BYTES", 150)):
            monkeypatch.setattr(divergence, name, value)
    rnd = random.Random(5)
    terms = ["a", "zz", "éß", "eightchr", "ninechars", "sixteencharacter", "seventeenlettersx", "日本語" * 4, "q" * 40, *(f"t{chr(97 + i)}" for i in range(26))]
    docs = []
    for _ in range(300):
        source = f"s{int(rnd.paretovariate(0.6)) % 9}"
        words = [terms[int(rnd.paretovariate(0.5)) % len(terms)] for _ in range(rnd.randrange(0, 30))]
        docs.append((" ".join(words).title(), rnd.choice(["en", "de", None]), source))
    docs.append((" ".join(rnd.choices(terms, k=500)), "en", "s1"))
    got = divergence.source_divergence(spark.createDataFrame(docs, "text string, lang string, source string"), ranks=5)
    assert sorted(map(tuple, got.collect())) == diverging(docs, ranks=5)


def test_radix_order_is_stable():
    rnd = np.random.default_rng(3)
    low, high = (rnd.integers(0, 1 << 63, 4000, dtype=np.uint64) >> np.uint64(s) for s in (1, 58))
    low[::3] = low[0]
    assert divergence.radix_order([low, high]).tolist() == np.lexsort((low, high)).tolist()


def test_shares_are_exact_beyond_64_bits(spark):
    n, total = 10**13 + 7, 10**15 + 11
    row = spark.createDataFrame([(n, total)], "n long, total long").select(divergence._share("n", "total")).first()
    assert row[0] == 1 + 10**9 * (n + 1) // total


VECTORS = [
    (0, [0.5, -0.25, 1.0]),
    (50, [0.5, -0.25, 1.0]),
    (100, [1.0]),
    (150, None),
    (200, [0.5, None, 1.0]),
    (250, [0.5, float("nan"), 1.0]),
    (300, [0.5, float("inf"), 1.0]),
    (350, []),
    (None, [9.0, 9.0, 9.0]),
    (3, [0.5, -0.25, 1.0]),
    (3, [0.5, -0.25, 1.0]),
    (1, [-0.001, 0.0, 0.0]),
    (5, [2.0]),
    (6, []),
    (8, [0.5, -0.25, 0.99]),
]


def nearest(rows, ranks=5):
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in fit:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fit if j != i and len(v) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:ranks], 1)]
    return sorted(out)


def search(spark, rows, kind="double", **more):
    vectors = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"vec_id long, embedding array<{kind}>, " + NOISE)
    got = pivots.exact_top_k(vectors.filter("vec_id % 50 = 0"), vectors, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def test_top_k_on_awkward_rows(spark):
    assert search(spark, VECTORS) == nearest(VECTORS)
    vectors = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    assert not pivots.exact_top_k(vectors.limit(0), vectors).collect()
    assert not pivots.exact_top_k(vectors, vectors.limit(0)).collect()


def test_top_k_in_blocks_with_a_common_vector(spark):
    rnd = random.Random(9)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [c + rnd.gauss(0, 0.1) for c in rnd.choice(centres)]) for i in range(1200)]
    rows += [(i, centres[0]) for i in range(2000, 2600)]
    want = nearest(rows)
    assert search(spark, rows, query_bytes=2000) == want
    assert search(spark, rows, pivots=1) == want


def test_top_k_of_long_vectors_is_exact(spark):
    rnd = random.Random(10)
    rows = [(i, [rnd.uniform(-1, 1) * 3e6 for _ in range(4)]) for i in range(0, 600, 10)]
    assert search(spark, rows) == nearest(rows)


def test_bounds_leave_candidates_out():
    rnd = np.random.default_rng(4)
    rows = (rnd.normal(0, 100, (20, 8)).repeat(200, axis=0) + rnd.normal(0, 5, (4000, 8))).astype(np.int64)
    longest = int((rows * rows).sum(axis=1).max())
    chosen = pivots.choose_pivots(rows[::10], longest, 32)
    queries = pivots.Queries(np.arange(5), rows[:5], chosen, longest, 5)
    table = pivots.distances(rows, chosen, longest)
    queries.search(np.arange(len(rows)), rows, table)
    counts = defaultdict(int)
    for q, (scores, ids) in enumerate(queries.best):
        every = rows @ rows[q]
        every[q] = np.iinfo(np.int64).min
        assert scores.tolist() == sorted(every.tolist(), reverse=True)[:5]
        counts[q] = len(ids)
    assert set(counts.values()) == {5} and queries.evaluated < 5 * len(rows) / 2
