"""Evaluation over tables of questions, answers and results.  (D12, J2-J4)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def route_summary(routed: DataFrame, route: str = "route") -> DataFrame:
    """Questions per route and their share in percent."""
    counts = routed.groupBy(route).agg(F.count(F.lit(1)).alias("questions"))
    whole = counts.agg(F.sum("questions")).scalar()
    return counts.withColumn("share_pct", F.lit(100.0) * F.col("questions") / whole)


def route_confusion(questions: DataFrame, expected: str = "expected", actual: str = "route") -> DataFrame:
    """Number of questions per pair of expected and actual route."""
    return questions.groupBy(expected, actual).agg(
        F.count(F.lit(1)).alias("questions"),
        F.first(F.col(expected) == F.col(actual)).alias("agrees"),
    )


def success_rate(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """An answer that says "error" or "cannot", or is missing, is a failure; one row."""
    text = F.lower(F.col(answer))
    failed = F.coalesce(text.contains("error") | text.contains("cannot"), F.lit(True))
    return answers.agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(~failed).alias("successes")
    ).withColumn("success_pct", F.try_divide(F.lit(100.0) * F.col("successes"), F.col("answers")))


_FLAT = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_BUCKETS = 4096


def _differing(signed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``signed`` in buckets of rows whose two sides differ; tables that are equal shuffle sums only.

    A bucket's sides are compared by their numbers of rows and sums of two 64-bit hashes, in halves that cannot overflow.
    """
    parts = [part for c in columns for part in (F.col(c), F.col(c).isNull())]

    def halves(h: Column) -> list[Column]:
        return [F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]

    hashed = signed.withColumn("__h", F.xxhash64(F.lit(1), *parts)).withColumn("__bucket", F.pmod("__h", F.lit(_BUCKETS)))
    summed = [F.lit(1), *halves(F.col("__h")), *halves(F.xxhash64(F.lit(2), *parts))]
    sums = hashed.groupBy("__bucket").agg(*[F.sum(F.col("__n") * x).alias(f"__s{i}") for i, x in enumerate(summed)])
    unequal = sums.filter(" OR ".join(f"__s{i} <> 0" for i in range(len(summed)))).select("__bucket")
    return hashed.join(F.broadcast(unequal), "__bucket", "left_semi").select(*signed.columns)


def result_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs between two results; empty when they are equal.

    Copies are counted with opposite signs in one aggregate, so equal rows meet map-side.  Rows without nested columns are first
    compared by bucket, and only buckets that differ are shuffled as rows.
    """
    columns = a.columns
    signed = a.select(*columns, F.lit(1).alias("__n")).unionAll(b.select(*columns, F.lit(-1).alias("__n")))
    if all(isinstance(f.dataType, _FLAT) for f in signed.schema.fields):
        signed = _differing(signed, columns)
    return (
        signed.groupBy(*columns)
        .agg(F.sum("__n").alias("__n"))
        .filter("__n <> 0")
        .select(
            *columns,
            F.when(F.col("__n") > 0, F.lit("a")).otherwise(F.lit("b")).alias("only_in"),
            F.abs("__n").alias("copies"),
        )
    )
