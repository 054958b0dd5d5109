"""The training-corpus pipeline: documents in, token digests out, one Parquet table between two stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.llm import bpe, cotrain, decontaminate, near_dup, pii
from starlens.llm.common import stored
from starlens.llm.queries import KEY, VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = cotrain.score(docs, cotrain.train(docs, labels))
    return scored.filter(f"`{scored.columns[-1]}`.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    A row goes by its doc_id and its text, so another text under the same id is judged by itself; of rows that repeat both,
    one stays.  Documents without an id can't be named by a group, so all of them stay.
    """
    found = stored(near_dup.near_duplicates(docs).filter("doc_id is not null").select("doc_id", "text_key", "kept"))
    gone = found.filter("not kept").select("doc_id", "text_key").distinct()
    again = found.filter("kept").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    again = again.select("doc_id", "text_key")
    rows = docs.alias("row")
    same = (F.col("row.doc_id") == F.col("named.doc_id")) & (near_dup.text_key("row.text") == F.col("named.text_key"))
    single = rows.join(gone.union(again).alias("named"), same, "left_anti")
    repeated = rows.join(again.alias("named"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.select(*docs.columns).union(repeated.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; a count of characters (n_chars) follows the text, if there is one."""
    found = pii.replace_entities(docs, KEY)
    if "n_chars" not in docs.columns:
        return found.select(*docs.columns)
    changed = F.size(found.columns[-1]) > 0
    kind = docs.schema["n_chars"].dataType
    n_chars = F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii_surrogates", personal_data),
    ("byte_bpe", tokens),
]

#: No stage but the third can be said in SQL; tests hold each stage to its columns, on whole and on awkward rows, and
#: near duplicates, decontamination and tokens to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
