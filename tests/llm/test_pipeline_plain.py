"""The whole pipeline against plain Python: every stage that has a plain definition, each on what the one before kept."""

import hashlib
import re
from itertools import combinations

import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL

import corpus_pipeline
from starlens.llm import bpe
from starlens.llm.common import stored
from starlens.llm.queries import VOCABULARY

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def tables(spark):
    """Documents, then what each stage but the last made of them."""
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(stored(stage(spark, out[-1], SMALL)))
    return [{r.doc_id: r.asDict() for r in t.collect()} for t in out]


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, {tuple(words[i : i + 10]) for i in range(len(words) - 9)} or ({tuple(words)} if words else set())


def test_quality_only_removes(tables):
    before, after = tables[0], tables[1]
    assert after and set(after) <= set(before) and all(after[i] == before[i] for i in after)


def test_near_duplicates_leave_the_least_of_each_group(tables):
    before, after = tables[1], tables[2]
    sets = {i: _shingles(r["text"]) for i, r in before.items()}
    label = {i: i for i in before}

    def least(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            one, two = sorted((least(a), least(b)))
            label[two] = one
    assert set(after) == {i for i in before if least(i) == i}


def test_decontamination_removes_what_holds_a_window(spark, tables):
    before, after = tables[2], tables[3]
    wanted = {}
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        for window in _windows(r.text)[1]:
            wanted.setdefault(len(window), set()).add(window)

    def hit(text):
        words = _windows(text)[0]
        return any(tuple(words[i : i + n]) in found for n, found in wanted.items() for i in range(len(words) - n + 1))

    assert set(after) == {i for i, r in before.items() if not hit(r["text"])}


def test_surrogates_keep_rows_and_every_other_column(tables):
    before, after = tables[3], tables[4]
    assert set(after) == set(before)
    for i, row in after.items():
        same = {"text", "n_chars"}
        assert {c: v for c, v in row.items() if c not in same} == {c: v for c, v in before[i].items() if c not in same}
        if row["text"] != before[i]["text"]:
            assert row["n_chars"] == len(row["text"])
            # Only entities change: lines stay lines.
            assert row["text"].count("\n") == before[i]["text"].count("\n")


def test_run_gives_the_librarys_tokens_of_what_is_left(spark, tables):
    tokens = bpe.read_ranks(VOCABULARY)
    ranks = {t: k for k, t in enumerate(tokens) if t}
    library = tiktoken.Encoding("p", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=ranks)
    expected = {}
    for i, row in tables[4].items():
        ids = library.encode_ordinary(row["text"] or "")
        digits = " ".join(map(str, ids)).encode()
        expected[i] = len(ids), hashlib.sha256(digits).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest()
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == expected and len(got) == len(expected)
