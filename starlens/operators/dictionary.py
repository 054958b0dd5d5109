"""Data dictionary and executable quality rules.  (H1-H13, J5)

A dictionary row describes a table (no column name) or one of its columns.  Descriptions come from
annotations; types and sample values are read from the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.joins import spread


DICTIONARY_SCHEMA = T.StructType(
    [
        T.StructField("catalog", T.StringType(), False),
        T.StructField("schema", T.StringType(), False),
        T.StructField("table_name", T.StringType(), False),
        T.StructField("table_type", T.StringType()),
        T.StructField("table_description", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("column_type", T.StringType()),
        T.StructField("column_description", T.StringType()),
        T.StructField("is_key", T.BooleanType()),
        T.StructField("is_measure", T.BooleanType()),
        T.StructField("related_table", T.StringType()),
        T.StructField("business_rules", T.StringType()),
        T.StructField("sample_values", T.StringType()),
    ]
)


@dataclass(frozen=True)
class ColumnNote:
    description: str | None
    is_key: bool = False
    is_measure: bool = False
    related: str | None = None
    rules: str | None = None


@dataclass(frozen=True)
class TableNote:
    kind: str
    description: str
    rules: str | None = None
    columns: Mapping[str, ColumnNote] = field(default_factory=dict)


#: A table, or a function that reads the named columns of it (all, if none is named) and joins only what they need.
Table = DataFrame | Callable[..., DataFrame]


def schema_of(table: Table) -> T.StructType:
    return table().schema if callable(table) else table.schema


def restricted(table: Table, columns: Sequence[str]) -> DataFrame:
    return table(*columns) if callable(table) else table.select(*columns)


# -- sample values -------------------------------------------------------------------------------


def as_text(field_: T.StructField) -> Column:
    """Readable text of a scalar column; numbers with a fraction keep two places."""
    col, kind = F.col(field_.name), field_.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return col.cast("decimal(20,2)").cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, "yyyy-MM-dd")
    return col.cast("string")


def sample_values(
    tables: Mapping[str, Table], k: int = 3, columns: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """H8: the first ``k`` distinct values of every column in text order, joined by commas.

    ``columns`` names the columns wanted of each table; nothing else is read.  One scan per table.  Each task
    keeps ``k`` values per column, and such samples merge, so the shuffle carries at most ``k`` rows per column and
    task however many distinct values there are.
    """
    parts = []
    for table, source in tables.items():
        wanted = None if columns is None else set(columns.get(table, ()))
        fields = [
            f
            for f in schema_of(source).fields
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) and (wanted is None or f.name in wanted)
        ]
        if not fields:
            continue
        names = [f.name for f in fields]
        texts = spread(restricted(source, names)).select(*[as_text(f).alias(f.name) for f in fields])

        def smallest(batches, names=names):
            best = {n: [] for n in names}
            for batch in batches:
                for n in names:
                    seen = pc.drop_null(pc.unique(batch.column(n)))
                    pool = pa.concat_arrays([seen, pa.array(best[n], type=seen.type)])
                    pool = pc.unique(pool)
                    order = pc.sort_indices(pool)[:k]
                    best[n] = pool.take(order).to_pylist()
            rows = [(n, v) for n in names for v in best[n]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())],
                names=["column_name", "value"],
            )

        found = texts.mapInArrow(smallest, "column_name string, value string").distinct()
        parts.append(found.select(F.lit(table).alias("table_name"), "column_name", "value"))
    if not parts:
        return SparkSession.active().createDataFrame([], "table_name string, column_name string, sample_values string")
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    order = Window.partitionBy("table_name", "column_name").orderBy("value")
    first = values.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return first.groupBy("table_name", "column_name").agg(
        F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("sample_values")
    )


def table_sizes(tables: Mapping[str, Table]) -> DataFrame:
    """(table_name, row_count), from one column of each table at most."""
    out = None
    for name, source in tables.items():
        rows = restricted(source, schema_of(source).names[:1])
        part = rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionByName(part)
    return out


# -- the dictionary ------------------------------------------------------------------------------


def entries(
    tables: Mapping[str, Table], notes: Mapping[str, TableNote], catalog: str = "spark_catalog", schema: str = "default"
) -> list[Row]:
    """The dictionary without samples, from notes and schemas only: for each noted table a row for itself and
    one for each of its columns, then one for each noted column that it doesn't have (without a type)."""
    names = [f.name for f in DICTIONARY_SCHEMA.fields[:-1]]
    unknown = ColumnNote(None)
    rows = []
    for name, note in notes.items():
        if name not in tables:
            continue
        types = {f.name: f.dataType.simpleString() for f in schema_of(tables[name]).fields}
        about = (catalog, schema, name, note.kind, note.description)
        rows.append(about + (None, None, None, False, False, None, note.rules))
        for column in dict.fromkeys([*types, *note.columns]):
            c = note.columns.get(column, unknown)
            rows.append(
                about + (column, types.get(column), c.description, c.is_key, c.is_measure, c.related, c.rules)
            )
    return [Row(*names)(*row) for row in rows]


def build_dictionary(
    tables: Mapping[str, Table],
    notes: Mapping[str, TableNote],
    catalog: str = "spark_catalog",
    schema: str = "default",
    samples: int | None = 3,
    asked: Callable[[Row], bool] = lambda row: True,
) -> DataFrame:
    """H1: one row per noted table and one per column of it, noted or not, with types and samples from the data.

    Only the rows that are ``asked`` for are made, and only their columns are read: a table row costs a count, a
    column row a sample of that column.
    """
    rows = [row for row in entries(tables, notes, catalog, schema) if asked(row)]
    spark = SparkSession.active()
    head = T.StructType(DICTIONARY_SCHEMA.fields[:-1])
    written = spark.createDataFrame(rows, head)
    if samples is None:
        return written.withColumn("sample_values", F.lit(None).cast("string"))
    columns = {t: [r.column_name for r in rows if r.table_name == t and r.column_name] for t in tables}
    seen = sample_values(tables, samples, columns)
    counted = {r.table_name: tables[r.table_name] for r in rows if r.column_name is None}
    if counted:
        sizes = table_sizes(counted).select(
            "table_name",
            F.lit(None).cast("string").alias("column_name"),
            F.concat(F.col("row_count").cast("string"), F.lit(" rows")).alias("sample_values"),
        )
        seen = seen.unionByName(sizes) if any(columns.values()) else sizes
    seen = seen.select(F.col("table_name").alias("t"), F.col("column_name").alias("c"), "sample_values")
    match = (F.col("table_name") == F.col("t")) & F.col("column_name").eqNullSafe(F.col("c"))
    return written.join(seen, match, "left").select(*[f.name for f in DICTIONARY_SCHEMA.fields])


def dictionary_tables(d: DataFrame) -> DataFrame:
    """H2: table descriptions."""
    return d.filter("column_name IS NULL").select(
        "table_name", "table_type", "table_description", "business_rules", "sample_values"
    ).distinct()


def dictionary_columns(d: DataFrame, table: str) -> DataFrame:
    """H3: the columns of one table, keys and measures first."""
    return (
        d.filter((F.col("table_name") == table) & F.col("column_name").isNotNull())
        .select(
            "column_name",
            "column_type",
            "column_description",
            "is_key",
            "is_measure",
            "related_table",
            "sample_values",
        )
        .orderBy(F.desc("is_key"), F.desc("is_measure"), "column_name")
    )


def dictionary_measures(d: DataFrame) -> DataFrame:
    """H4: all measures."""
    return d.filter("is_measure").select(
        "table_name", "column_name", "column_type", "column_description", "business_rules", "sample_values"
    )


def dictionary_relationships(d: DataFrame) -> DataFrame:
    """H5: key columns that name a related table, with the direction of the link."""
    direction = F.when(F.col("table_type") == "fact", F.lit("foreign key")).otherwise(F.lit("referenced by"))
    return d.filter("is_key AND related_table IS NOT NULL").select(
        F.col("table_name").alias("source_table"),
        F.col("column_name").alias("key_column"),
        F.col("related_table").alias("target_table"),
        direction.alias("direction"),
        "column_description",
        "sample_values",
    )


def dictionary_counts(d: DataFrame) -> DataFrame:
    """H6: entries per table, split into table level and column level."""
    return d.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if(F.col("column_name").isNull()).alias("table_level"),
        F.count_if(F.col("column_name").isNotNull()).alias("column_level"),
        F.count("sample_values").alias("with_samples"),
    )


def undocumented_columns(columns: DataFrame, d: DataFrame) -> DataFrame:
    """H7: catalog columns (table_name, col_name, ...) without a description in the dictionary."""
    known = d.filter("column_name IS NOT NULL AND column_description IS NOT NULL").select("table_name", F.col("column_name").alias("col_name"))
    return columns.join(known, ["table_name", "col_name"], "left_anti")


def dictionary_preview(d: DataFrame, n: int = 10) -> DataFrame:
    """The first rows of the dictionary, table rows before their columns."""
    return d.orderBy("table_name", F.asc_nulls_first("column_name")).limit(n)


# -- schema documents ----------------------------------------------------------------------------


def _document(lines: DataFrame, keys: Sequence[str], order: Sequence[str], sep: str) -> DataFrame:
    """Joins the ``line`` column per key in order; a table's columns bound the list."""
    entries = F.sort_array(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(entries, lambda e: e["line"]), sep).alias("body"))


def context_documents(d: DataFrame, namespace: str | None = None) -> DataFrame:
    """H9: (section, table_name, document): one rich schema text per table, then the relationships
    and the measures of the whole dictionary."""
    prefix = f"{namespace}." if namespace else ""
    marker = F.concat(
        F.when(F.col("is_key") & F.col("related_table").isNull(), F.lit(" [PRIMARY KEY]")).otherwise(""),
        F.when(
            F.col("related_table").isNotNull(), F.concat(F.lit(" [FOREIGN KEY → "), "related_table", F.lit("]"))
        ).otherwise(""),
        F.when(F.col("is_measure"), F.lit(" [MEASURE]")).otherwise(""),
    )
    line = F.concat_ws(
        "\n",
        F.concat(F.lit("• "), "column_name", F.lit(" ("), "column_type", F.lit(")"), marker),
        F.concat(F.lit("  Description: "), "column_description"),
        F.concat(F.lit("  Business Rules: "), "business_rules"),
        F.concat(F.lit("  Sample Values: "), "sample_values"),
    )
    columns = d.filter("column_name IS NOT NULL").select(
        "table_name",
        (~F.col("is_key")).alias("o1"),
        (~F.col("is_measure")).alias("o2"),
        F.col("column_name").alias("o3"),
        line.alias("line"),
    )
    heads = d.filter("column_name IS NULL").select("table_name", "table_type", "table_description")
    per_table = (
        heads.join(_document(columns, ["table_name"], ["o1", "o2", "o3"], "\n"), "table_name", "left")
        .select(
            F.lit("table").alias("section"),
            "table_name",
            F.concat(
                F.lit(f"TABLE: {prefix}"),
                "table_name",
                F.lit(" ("),
                F.upper(F.coalesce("table_type", F.lit(""))),
                F.lit(")\nDescription: "),
                F.coalesce("table_description", F.lit("")),
                F.lit("\nCOLUMNS:\n"),
                F.coalesce("body", F.lit("")),
            ).alias("document"),
        )
    )
    links = dictionary_relationships(d).select(
        F.lit("relationships").alias("section"),
        F.concat(
            F.lit(f"{prefix}"), "source_table", F.lit("."), "key_column", F.lit(f" → {prefix}"), "target_table"
        ).alias("line"),
    )
    measures = dictionary_measures(d).select(
        F.lit("measures").alias("section"),
        F.concat(F.lit("• "), "column_name", F.lit(": "), "column_description").alias("line"),
    )
    common = _document(
        links.unionByName(measures).withColumn("o", F.col("line")), ["section"], ["o"], "\n"
    ).select("section", F.lit("").alias("table_name"), F.col("body").alias("document"))
    return per_table.unionByName(common)


def basic_schema_documents(columns: DataFrame, fact: str) -> DataFrame:
    """Plain schema text per table from the catalog listing (table_name, position, ...)."""
    lines = columns.select(
        "table_name",
        "position",
        F.concat(F.lit("  - "), "col_name", F.lit(" ("), "data_type", F.lit(")")).alias("line"),
    )
    kind = F.when(F.col("table_name") == fact, F.lit("Fact Table")).otherwise(F.lit("Dimension Table"))
    return _document(lines, ["table_name"], ["position"], "\n").select(
        "table_name", F.concat(kind, F.lit(": "), "table_name", F.lit("\nColumns:\n"), "body").alias("document")
    )


def rich_context_used(documents: DataFrame, column: str = "document") -> DataFrame:
    """Does a schema text carry business rules?"""
    return documents.withColumn("rich_context", F.col(column).contains("Business Rules:"))


# -- rules ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Check:
    """Rows of ``table`` must satisfy ``condition``; unknown counts as a violation."""

    name: str
    table: str
    condition: Column


@dataclass(frozen=True)
class ForeignKey:
    name: str
    table: str
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class Unique:
    """No two rows of ``table`` share the values of ``columns``."""

    name: str
    table: str
    columns: tuple[str, ...]


def positive(name: str, table: str, column: str) -> Check:
    return Check(name, table, F.col(column) > 0)


def not_after(name: str, table: str, column: str, as_of: str) -> Check:
    """Dates up to and including ``as_of``."""
    return Check(name, table, F.to_date(column) <= F.lit(as_of).cast("date"))


def matches(name: str, table: str, column: str, pattern: str) -> Check:
    return Check(name, table, F.col(column).rlike(pattern))


def max_length(name: str, table: str, column: str, n: int) -> Check:
    return Check(name, table, F.col(column).isNull() | (F.length(column) <= n))


def product_of(name: str, table: str, total: str, a: str, b: str, tolerance: float = 0.01) -> Check:
    return Check(name, table, F.abs(F.col(total) - F.col(a) * F.col(b)) <= tolerance)


# Formats of ids, e-mail addresses and zip codes.
ITEM_ID = r"^p-\d+$"
LOCATION_ID = r"^l-\d+$"
CUSTOMER_ID = r"^c-\d+$"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
ZIP_CODE = r"^\d{5}$"


def _key_counts(tables: Mapping[str, DataFrame], rules: Sequence[ForeignKey]) -> DataFrame:
    """(rule, checked, violations) of foreign keys: child and parent keys meet in one aggregate, without joins.

    Every table is read once as a child and once as a parent: its columns are unpivoted to (rule, key).  A child key that no parent
    has, or a null, is a violation for each of its rows.
    """
    seen = []
    for side, table_of in (("child", lambda r: r.table), ("parent", lambda r: r.parent)):
        for table in {table_of(r): None for r in rules}:
            entries = []
            for r in rules:
                if table_of(r) == table:
                    kind = tables[r.parent].schema[r.parent_column].dataType
                    column = r.column if side == "child" else r.parent_column
                    entries.append(F.struct(F.lit(r.name).alias("rule"), F.col(column).cast(kind).cast("string").alias("k")))
            rows = tables[table].select(F.inline(F.array(*entries)))
            if side == "parent":
                rows = rows.filter("k IS NOT NULL")
            child = F.lit(int(side == "child")).cast("bigint")
            seen.append(rows.select("rule", "k", child.alias("n"), F.lit(side == "parent").alias("parent")))
    every = seen[0]
    for rows in seen[1:]:
        every = every.unionByName(rows)
    per_key = every.groupBy("rule", "k").agg(F.sum("n").alias("n"), F.max("parent").alias("known"))
    return per_key.groupBy("rule").agg(
        F.sum("n").alias("checked"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("violations")
    )


def run_rules(tables: Mapping[str, DataFrame], rules: Iterable[Check | ForeignKey | Unique]) -> DataFrame:
    """(rule, checked, violations), one row per rule.

    All row checks of a table share one scan, and so do all its foreign keys.  Rows are counted per key
    map-side, so a hot key is one row per task.  Give raw tables: a join that drops orphans hides them.
    """
    rules = list(rules)
    parts = []
    by_table: dict[str, list[Check]] = {}
    for rule in rules:
        if isinstance(rule, Check):
            by_table.setdefault(rule.table, []).append(rule)
    for table, checks in by_table.items():
        failed = [
            F.count_if(~F.coalesce(c.condition, F.lit(False))).alias(f"v{i}") for i, c in enumerate(checks)
        ]
        counts = tables[table].agg(F.count(F.lit(1)).alias("checked"), *failed)
        entries = [
            F.struct(F.lit(c.name).alias("rule"), "checked", F.col(f"v{i}").alias("violations"))
            for i, c in enumerate(checks)
        ]
        parts.append(counts.select(F.inline(F.array(*entries))))
    keys = [rule for rule in rules if isinstance(rule, ForeignKey)]
    if keys:
        parts.append(_key_counts(tables, keys))
    for rule in rules:
        if isinstance(rule, Unique):
            per_key = tables[rule.table].groupBy(*rule.columns).agg(F.count(F.lit(1)).alias("n"))
            parts.append(
                per_key.agg(
                    F.lit(rule.name).alias("rule"),
                    F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
                    F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("violations"),
                )
            )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
