"""Text built from rows, token windows, keyword predicates.  (B5, B6, C2, C8)"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def describe_row(columns: Sequence[str], sep: str = " | ") -> Column:
    """``"column: value"`` parts joined by ``sep``; null values and hidden columns left out."""
    parts = [
        F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in columns if not c.startswith("_")
    ]
    return F.concat_ws(sep, *parts)


def stringify_attributes(df: DataFrame) -> DataFrame:
    """Every column as text."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def truncate_tokens(text: str | Column, max_tokens: int) -> Column:
    """The first ``max_tokens`` whitespace-separated tokens, as an encoder window keeps them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, max_tokens), " ")


def contains_any(term: str, columns: Sequence[str]) -> Column:
    """Case-insensitive containment of a term in any of the columns."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False))
    return out
