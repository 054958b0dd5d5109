"""op5 against the library over whole documents, and pipeline stages on awkward rows."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL

import corpus_pipeline
from starlens.llm import bpe
from starlens.llm.queries import VOCABULARY, op5_byte_bpe


def _library():
    tokens = bpe.read_ranks(VOCABULARY)
    ranks = {t: i for i, t in enumerate(tokens) if t}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=ranks)


def _digests(library, text):
    ids = library.encode_ordinary(text or "")
    return (
        len(ids),
        hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(library.decode_bytes(ids)).hexdigest(),
    )


def test_op5_over_documents_is_the_librarys(spark):
    library = _library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = op5_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _digests(library, texts[r.doc_id])


def test_op5_on_awkward_texts(spark):
    library = _library()
    rows = [(1, None), (2, ""), (3, "a" * 200_000), (4, "the cat " * 60_000), (4, "é日本😀\x00\n\t"), (None, " x ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN).collect())
    assert got == sorted(_digests(library, t) for _, t in rows)


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs.limit(20).collect()
    names = docs.columns
    made = [tuple(r) for r in first]
    def row(i, text):
        values = {"doc_id": i, "text": text, "lang": None, "source": None, "n_chars": None}
        return tuple(values[c] for c in names)
    made += [row(900_001, None), row(900_002, ""), row(None, "some text without an id"), row(900_003, "word " * 20_000), made[0], made[0]]
    return spark.createDataFrame(made, docs.schema)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_on_awkward_rows(spark, rows, name, stage):
    out = stage(spark, rows, SMALL)
    assert out.columns == rows.columns and out.dtypes == rows.dtypes
    kept, given = out.collect(), {r.doc_id for r in rows.collect()}
    assert len(kept) <= rows.count() and {r.doc_id for r in kept} <= given
    assert stage(spark, rows.limit(0), SMALL).count() == 0


def test_near_duplicates_stage_keeps_one_of_each_text(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " x"), (4, "another text altogether")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()) == [1, 4]


def test_near_duplicates_stage_goes_by_id_and_text(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(1, one, "a"), (1, one, "a"), (2, one, "b"), (3, two, "c"), (3, one, "d"), (4, two, "e"), (None, three, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    got = sorted(((r.doc_id or 0, r.text[0], r.text_key) for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()))
    assert got == [(0, "z", "f"), (1, "x", "a"), (3, "y", "c")]
