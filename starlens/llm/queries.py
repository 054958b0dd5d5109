"""One named query for each operator, over the whole of its table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.llm import (
    bpe,
    cotrain,
    decontaminate,
    divergence,
    langid,
    near_dup,
    oracles,
    pii,
    pivots,
    quality_rules,
    recompress,
    secret_scan,
    suffix_dedup,
    term_tree,
)

#: The key of this data set's surrogates; a real one comes from a secret store.
KEY = "starlens-demo-key"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


def op1_pii_surrogates(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, number of entities of each kind, and the rewritten text."""
    found = pii.replace_entities(documents(spark, root).select("doc_id", "text"), KEY)
    entities = found.columns[-1]
    return found.select(
        "doc_id",
        *(
            F.size(F.filter(F.transform(entities, lambda e: e["kind"]), lambda x: x == F.lit(k))).cast("bigint").alias(f"n_{k}")
            for k in pii.KINDS
        ),
        F.size(entities).cast("bigint").alias("n_entities"),
        "text",
    )


def op2_near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    found = near_dup.near_duplicates(documents(spark, root), size=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_language_id(spark: SparkSession, root: str) -> DataFrame:
    found = langid.identify_languages(documents(spark, root))
    return found.select(
        "doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans")
    )


def op4_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    return recompress.remove_repeats(documents(spark, root)).drop("kept_text")


def op5_byte_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, root), VOCABULARY, public_tokenizers.PATTERN)


def op6_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, root)).drop("found")


def op7_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(documents(spark, root)).drop("kept")


def op8_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    found = quality_rules.quality_rules(documents(spark, root))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    return cotrain.classify(documents(spark, root), spark.read.parquet(f"{root}/labels.parquet"))


def op10_decontamination(spark: SparkSession, root: str) -> DataFrame:
    found = decontaminate.decontaminate(
        documents(spark, root), spark.read.parquet(f"{root}/benchmark.parquet")
    )
    return found.drop("spans", "items")


def op11_ranked_search(spark: SparkSession, root: str) -> DataFrame:
    return term_tree.ranked_search(documents(spark, root), spark.read.parquet(f"{root}/benchmark.parquet"))


def op12_source_divergence(spark: SparkSession, root: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, root))


def op13_exact_top_k(spark: SparkSession, root: str) -> DataFrame:
    vectors = spark.read.parquet(f"{root}/embeddings.parquet")
    return pivots.exact_top_k(vectors.filter("vec_id % 50 = 0"), vectors)


def pipeline(spark: SparkSession, root: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, root)


_ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_pii_surrogates,
    op2_near_duplicates,
    op3_language_id,
    op4_substring_dedup,
    op5_byte_bpe,
    op6_secret_scan,
    op7_suffix_dedup,
    op8_quality_rules,
    op9_quality_classifier,
    op10_decontamination,
    op11_ranked_search,
    op12_source_divergence,
    op13_exact_top_k,
    pipeline,
)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def all_oracles() -> dict[str, str]:
    return {
        "op2_near_duplicates": oracles.NEAR_DUPLICATES,
        "op4_substring_dedup": oracles.SUBSTRINGS,
        "op6_secret_scan": oracles.SECRETS,
        "op8_quality_rules": oracles.QUALITY,
        "op10_decontamination": oracles.DECONTAMINATION,
        "op11_ranked_search": oracles.RANKED_SEARCH,
        "op12_source_divergence": oracles.DIVERGENCE,
        "op13_exact_top_k": oracles.TOP_K,
    }
