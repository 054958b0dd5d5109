"""Ids that several texts carry, and words that weak hashes confuse."""

import hashlib
import random

from starlens.llm import near_dup, recompress
from starlens.llm.common import Words


def _brute(rows, size):
    """By row: number of words, number removed, digest of the rest."""
    words = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            if i is not None:
                first[tuple(w[k : k + size])] = min(i, first.get(tuple(w[k : k + size]), i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def _removed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(
        (-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256)
        for r in recompress.remove_repeats(df).collect()
    )


def test_rows_of_one_id_are_judged_one_by_one(spark):
    w = " ".join(f"w{k}" for k in range(80))
    v = " ".join(f"v{k}" for k in range(90))
    cases = [
        [(1, w), (5, w), (5, f"zz {w} yy")],
        [(1, w), (5, f"zz {w} yy"), (5, v)],
        [(1, w), (1, v), (1, w), (2, f"{v} {w}"), (2, v), (3, None), (3, w), (None, w)],
        [(4, w), (4, w), (4, w.replace(" ", "\n")), (7, f"{w} end"), (7, f"{w} end")],
    ]
    for rows in cases:
        assert _removed(spark, rows) == _brute(rows, 50)


def test_random_rows_with_repeated_ids(spark):
    rnd = random.Random(12)
    passages = [" ".join(rnd.choice("abcdefghij") + str(rnd.randrange(60)) for _ in range(rnd.randrange(40, 75))) for _ in range(9)]
    rows = [(rnd.randrange(12), " ".join(rnd.choices(passages, k=rnd.randrange(1, 4)))) for _ in range(60)]
    assert _removed(spark, rows) == _brute(rows, 50)


def _thue_morse(n, a, b):
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return [(a, b)[x] for x in s[:n]]


def test_words_that_sums_of_powers_confuse(spark):
    one, two = "".join(_thue_morse(2048, "a", "b")), "".join(_thue_morse(2048, "b", "a"))
    assert len(set(Words([one.encode(), two.encode()]).hashes.tolist())) == 2
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dup.near_duplicates(docs, 3, 85, 100).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (1, False)}


def test_texts_that_sums_of_powers_confuse(spark):
    rows = [(1, " ".join(_thue_morse(2048, "a", "b"))), (2, " ".join(_thue_morse(2048, "b", "a")))]
    keys = recompress._sequence_keys(Words([t.encode() for _, t in rows]))
    assert keys[0] != keys[1]
    assert _removed(spark, rows) == _brute(rows, 50)
