"""Line-first quality rules, as column expressions only.

Every line is judged first (punctuation, navigation, boilerplate, shouting, repetition, copies of earlier
lines); failing lines are removed; a document that loses too much of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import texts_of

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

# Fixed phrases of pages rather than of prose, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "we use cookies",
    "accept cookies",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "sign up for our newsletter",
    "is licensed under the",
)
# Beginnings of short lines that lead elsewhere, and sentence ends.
NAVIGATION = (
    r"^(home|menu|login|log in|sign in|sign up|search|next|previous|back to top|skip to content|share|read more"
    r"|click here)([^a-z]|\z)"
)
SENTENCE_END = r"""[.!?:;…。！？؟।]([\x20\x09-\x0D"'”’»)\]]|\z)"""


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def measured(line: Column) -> Column:
    """What the rules ask of a line more than once: itself, in lower case, and its number of words."""
    return F.struct(
        line.alias("line"), F.lower(line).alias("low"), F.regexp_count(line, F.lit(WORD + "+")).alias("words")
    )


def line_passes(measured_line: Column, longest_list_line: int = 3, min_prose: int = 12) -> Column:
    """Whether one ``measured`` line may stay; a line without a word always may.

    It fails with a symbol of ``#*$%&|<>`` for every four words or more, as navigation of at most
    ``longest_list_line`` words, as a boilerplate phrase, with a "!!" for every two words or more, with at
    least ``min_prose`` words but no closing punctuation at the end of any of them, or with fewer than a third
    of its words distinct (of ``min_prose`` or more).
    """
    line, low, words = (measured_line[name] for name in ("line", "low", "words"))
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(p))
    bad = (
        (F.regexp_count(line, F.lit(SYMBOL)) * 4 >= words)
        | ((words <= longest_list_line) & low.rlike(NAVIGATION))
        | phrase
        | (F.contains(line, F.lit("!!")) & (F.regexp_count(line, F.lit("!!")) * 2 >= words))
        | ((words >= min_prose) & ~line.rlike(SENTENCE_END))
        | ((words >= min_prose) & (F.size(F.array_distinct(split_words(line))) * 3 < words))
    )
    return (words == 0) | ~bad


def quality_rules(docs: DataFrame, min_words: int = 50, max_loss_pct: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines, n_lines_removed, chars_removed, clean_text.

    ``base_failed``: fewer than ``min_words`` words, or more than half of the words in three-word windows
    that occur twice or more.  ``kept``: not ``base_failed``, and at most ``max_loss_pct`` percent of the
    characters of words stand in removed lines.  Null and empty texts have no words, so they fail.
    Repeated rows each get their row; an empty table gives none.  Long texts cost time in proportion.
    """
    d = texts_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", split_words(F.col("text")).alias("w"), F.split("text", "\n").alias("all_lines"))
    d = d.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        F.filter("all_lines", lambda x: x.rlike(WORD)).alias("lines"),
        "all_lines",
        # A window is known by the 64-bit hash of its three words.
        F.when(
            F.size("w") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("w") - 3),
                lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("h"),
    )
    d = d.withColumn("ordered", F.when(F.size(F.array_distinct("h")) < F.size("h"), _numbered(F.col("h"))))
    d = d.withColumn(
        "starts",
        F.array_sort(
            F.transform(
                F.filter(
                    "ordered",
                    lambda x, i: (F.get("ordered", i - 1)["h"] == x["h"]) | (F.get("ordered", i + 1)["h"] == x["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    d = d.withColumn(
        "n_repeat_words",
        F.coalesce(
            F.aggregate(
                F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - p, F.lit(3)))),
                F.lit(0).cast("bigint"),
                lambda n, x: n + x,
            ),
            F.lit(0),
        ),
    )
    # Lines that fail by themselves, and copies of an earlier line.
    d = d.withColumn("passing", F.filter(F.transform("lines", measured), lambda x: line_passes(x)))
    d = d.withColumn("fresh", F.array_distinct(F.transform("passing", lambda x: x["line"])))
    d = d.withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
    ).withColumn(
        "chars_removed",
        F.col("word_chars") - F.length(F.regexp_replace(F.array_join("fresh", ""), SPACE, "")),
    )
    return d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("chars_removed") * 100 <= F.col("word_chars") * max_loss_pct)).alias("kept"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("fresh")).cast("bigint").alias("n_lines_removed"),
        F.col("chars_removed").cast("bigint").alias("chars_removed"),
        F.array_join("fresh", "\n").alias("clean_text"),
    )


def _numbered(h: Column) -> Column:
    """(hash, place) in the order of the hashes."""
    return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
