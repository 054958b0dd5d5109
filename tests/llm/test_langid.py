"""Language spans against a plain search over all labelings, and the cases that the contract names."""

import itertools

import numpy as np
import pytest

from starlens.llm import langid


def _best_value(scores, switch):
    n, k = scores.shape
    return max(
        sum(scores[t, s[t]] for t in range(n)) - switch * sum(a != b for a, b in itertools.pairwise(s))
        for s in itertools.product(range(k), repeat=n)
    )


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_is_the_best_of_all_labelings(seed):
    rng = np.random.default_rng(seed)
    sizes = [0, 1, 5, 3, 0, 6]
    words_to = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 4, (sum(sizes), 3)).astype(np.float32)
    labels = langid.viterbi(scores, words_to, 2.5)
    for a, b in itertools.pairwise(words_to):
        own = labels[a:b]
        value = sum(scores[a + t, label] for t, label in enumerate(own)) - 2.5 * int((np.diff(own) != 0).sum())
        if b > a:
            assert value == pytest.approx(_best_value(scores[a:b], 2.5), abs=1e-4)


def test_two_hundred_languages():
    scores = np.zeros((4, 200), np.float32)
    scores[:2, 150] = scores[2:, 199] = 50
    assert langid.viterbi(scores, np.array([0, 4])).tolist() == [150, 150, 199, 199]


def test_word_scores_are_sums_over_letters():
    part = langid.Letters(["ab cde", None, "f"])
    weights = np.random.default_rng(1).normal(size=(langid.BUCKETS, 5)).astype(np.float32)
    got = langid.word_scores(weights, part)
    ends = np.append(part.starts[1:], len(part.buckets))
    for row, a, b in zip(got, part.starts, ends):
        assert row == pytest.approx(weights[part.buckets[a:b]].sum(0), rel=1e-4)


def test_marks_alone_are_no_words():
    part = langid.Letters(["́́ ̀", "éa ́ b", ""])
    assert part.words_to.tolist() == [0, 0, 2, 2]
    assert part.lengths.tolist() == [3, 1]


def test_awkward_texts(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "́́", None), (4, None, "en"),
            (5, "12 34 !", None), (6, "", "de"), (6, "the the the", None), (None, "die der das", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.filter("doc_id < 3"))
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert {(3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0), (6, "und", 0.0)} <= got
    assert {(1, "en", 1.0), (2, "de", 1.0), (6, "en", 1.0), (None, "de", 1.0)} <= got
    nothing = langid.train(docs.filter("doc_id < 0"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_very_long_text(spark):
    text = "the cat and the dog " * 100_000 + "der Hund und die Katze " * 50_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    known = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de")], "text string, lang string")
    row = langid.identify(docs, langid.train(known)).first()
    assert row.lang_pred in ("en", "de") and len(row.spans) == 2
