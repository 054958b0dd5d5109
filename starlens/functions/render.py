"""Answer lines as columns.  (I1-I4)"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.functions.questions import MONTH_NAMES
from starlens.joins import lookup_join
from starlens.session import cut_lineage

# Column names shown as money, and the texts of empty answers.
MONEY_NAMES = ("revenue", "sales", "total", "amount", "value")
NO_MATCH = "No relevant results found."


def number_text(field: T.StructField, money: Sequence[str] = MONEY_NAMES) -> Column:
    """A value as text: money with two places, numbers with thousands separators, others as they are."""
    col, kind = F.col(field.name), field.dataType
    if isinstance(kind, T.NumericType):
        if field.name.lower() in money:
            return F.concat(F.lit("$"), F.format_number(col, 2))
        if isinstance(kind, T.IntegralType):
            return F.format_number(col, 0)
        # Up to six places, without trailing zeros but with at least one digit.
        return F.regexp_replace(F.format_number(col, 6), r"(\.\d+?)0+$", "$1")
    return col.cast("string")


def row_text(fields: Sequence[T.StructField], money: Sequence[str] = MONEY_NAMES) -> Column:
    """``"column: value"`` parts joined by commas; nulls left out."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{f.name}: "), number_text(f, money)) for f in fields])


def result_lines(df: DataFrame, position: str = "position", money: Sequence[str] = MONEY_NAMES) -> DataFrame:
    """(position, line) for each row of a numbered result; ``money`` may name further columns."""
    fields = [f for f in df.schema.fields if f.name != position]
    return df.select(
        position, F.concat(F.col(position).cast("string"), F.lit(". "), row_text(fields, money)).alias("line")
    )


def joined_lines(lines: DataFrame, header: str | Column, empty: str | Column, position: str = "position") -> DataFrame:
    """One row ``answer``: header and the lines in order, or the text for an empty result.

    For results that a top-k or a preview has made short.
    """
    header = F.lit(header) if isinstance(header, str) else header
    empty = F.lit(empty) if isinstance(empty, str) else empty
    ordered = lines.agg(F.sort_array(F.collect_list(F.struct(position, "line"))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda e: e["line"]), "\n")
    return ordered.select(F.when(F.size("ls") == 0, empty).otherwise(F.concat(header, F.lit("\n"), body)).alias("answer"))


def result_answer(df: DataFrame, description: str = "", position: str = "position") -> DataFrame:
    """The whole answer of a numbered result."""
    return joined_lines(
        result_lines(df, position),
        f"{description}:" if description else "Query results:",
        f"No results found for: {description}",
        position,
    )


def semantic_lines(ranked: DataFrame, nodes: DataFrame, key: str = "node_id", text: str = "node_text") -> DataFrame:
    """(query_id, rank, line) for each hit: ``- k: v, k: v (relevance: 0.123)``.

    Only nodes that were hit take part in the join, each once, so a popular node costs one row.  The hits are read twice,
    so the search is written once and not run twice.
    """
    ranked = cut_lineage(ranked)
    hit = nodes.select(key, text).join(ranked.select(key).distinct(), key, "left_semi")
    shown = lookup_join(ranked.select("query_id", key, "score", "rank"), hit, key, salts=4)
    score = F.format_number(F.col("score").cast("double"), 3)
    return shown.select(
        "query_id",
        "rank",
        F.concat(F.lit("- "), F.col(text), F.lit(" (relevance: "), score, F.lit(")")).alias("line"),
    )


def semantic_answers(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """(query_id, answer) for every query; top-k bounds the lines of one answer."""
    bodies = lines.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda e: e["line"]), "\n").alias("body")
    )
    return queries.select("query_id").join(bodies, "query_id", "left").select(
        "query_id",
        F.coalesce(F.concat(F.lit("Most relevant items:\n"), "body"), F.lit(NO_MATCH)).alias("answer"),
    )


def month_name(month: Column) -> Column:
    names = F.array(*[F.lit(m.capitalize()) for m in MONTH_NAMES])
    return F.get(names, month - 1)


def date_phrase(year: Column, month: Column, quarter: Column) -> Column:
    """`` in December 2025``, `` in Q4 2025``, `` in 2025`` or nothing; quarter is tried before year."""
    return (
        F.when(month.isNotNull() & year.isNotNull(), F.concat(F.lit(" in "), month_name(month), F.lit(" "), year.cast("string")))
        .when(quarter.isNotNull() & year.isNotNull(), F.concat(F.lit(" in Q"), quarter.cast("string"), F.lit(" "), year.cast("string")))
        .when(year.isNotNull(), F.concat(F.lit(" in "), year.cast("string")))
        .otherwise(F.lit(""))
    )


def _optional(n: int | None) -> Column:
    return F.lit(n).cast("int")


def buyer_line(position: str, name: str, ident: str, contact: str | None) -> Column:
    parts = [F.col(position).cast("string"), F.lit(". "), F.col(name), F.lit(" (ID: "), F.col(ident).cast("string"), F.lit(")")]
    if contact:
        parts += [F.lit(" - "), F.col(contact)]
    return F.concat(*parts)


def bought_lines(
    summary: DataFrame,
    customers: DataFrame,
    year: int | None = None,
    month: int | None = None,
    quarter: int | None = None,
    name: str = "customer_name",
    ident: str = "customer_id",
    contact: str | None = "customer_email",
) -> DataFrame:
    """One-row answer from a relation summary and the preview of its customers.

    ``summary`` has product_a, product_b, found flags and counts; ``customers`` has position and more.
    """
    when = date_phrase(_optional(year), _optional(month), _optional(quarter))
    s = summary.withColumn("when", when)
    lines = customers.select("position", "more", buyer_line("position", name, ident, contact).alias("line"))
    listed = lines.agg(
        F.struct(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda e: e["line"]), "\n").alias("body"),
            F.max("more").alias("more"),
        )
    ).scalar()
    pair = F.col("product_b").isNotNull()
    title = F.when(
        pair,
        F.concat(F.lit("Customers who bought both '"), "product_a", F.lit("' AND '"), "product_b", F.lit("'"), "when", F.lit(":")),
    ).otherwise(F.concat(F.lit("Customers who bought '"), "product_a", F.lit("'"), "when", F.lit(":")))
    missing = F.when(~F.col("a_found"), F.col("product_a")).otherwise(F.col("product_b"))
    note = F.concat(
        F.lit("\nNote:\n  • "),
        F.col("total_customers_with_a").cast("string"),
        F.lit(" customers bought '"),
        "product_a",
        F.lit("'"),
        "when",
        F.lit("\n  • "),
        F.col("total_customers_with_b").cast("string"),
        F.lit(" customers bought '"),
        "product_b",
        F.lit("'"),
        "when",
    )
    nobody = F.when(
        pair, F.concat(F.lit("No customers found who purchased both products"), "when", F.lit("."), note)
    ).otherwise(F.concat(F.lit("No customers found who purchased this product"), "when", F.lit(".")))
    more = F.when(
        F.col("l.more") > 0, F.concat(F.lit("\n... and "), F.col("l.more").cast("string"), F.lit(" more customers"))
    ).otherwise("")
    found = F.concat(F.lit("Found "), F.col("count").cast("string"), F.lit(" customers:\n"), F.col("l.body"), more)
    return s.withColumn("l", listed).select(
        F.when(
            F.col("outcome") == "product not found", F.concat(F.lit("Product '"), missing, F.lit("' not found"))
        )
        .when(F.col("outcome") == "no customers", F.concat(title, F.lit("\n"), nobody))
        .otherwise(F.concat(title, F.lit("\n"), found))
        .alias("answer")
    )


def measure_text(value: Column, measure: str) -> Column:
    """Revenue as money, counts as transactions, anything else as units."""
    if measure == "total_sales_value":
        return F.concat(F.lit("$"), F.format_number(value, 2))
    if measure in ("count", "COUNT(*)"):
        return F.concat(F.format_number(value.cast("bigint"), 0), F.lit(" transactions"))
    return F.concat(F.format_number(value, 0), F.lit(" units"))


def top_lines(
    df: DataFrame, name: str, value: str, measure: str, count: str = "transaction_count", position: str = "position"
) -> DataFrame:
    """I4: (position, line): ``1. name - $x (n transactions)``."""
    line = F.concat(
        F.col(position).cast("string"),
        F.lit(". "),
        F.col(name),
        F.lit(" - "),
        measure_text(F.col(value), measure),
        F.lit(" ("),
        F.col(count).cast("string"),
        F.lit(" transactions)"),
    )
    return df.select(position, line.alias("line"))


def top_title(
    entity: str, measure: str, n: int, year: int | None = None, month: int | None = None, quarter: int | None = None
) -> Column:
    return F.concat(
        F.lit(f"Top {n} {entity.replace('_', ' ')}"),
        date_phrase(_optional(year), _optional(month), _optional(quarter)),
        F.lit(f" by {measure}:"),
    )


def top_answer(
    df: DataFrame,
    name: str,
    value: str,
    measure: str,
    entity: str,
    n: int,
    year: int | None = None,
    month: int | None = None,
    quarter: int | None = None,
) -> DataFrame:
    """I4: the whole ranking as one answer."""
    when = date_phrase(_optional(year), _optional(month), _optional(quarter))
    return joined_lines(
        top_lines(df, name, value, measure),
        top_title(entity, measure, n, year, month, quarter),
        F.concat(F.lit("No data found for the specified filters"), when, F.lit(".")),
    )
