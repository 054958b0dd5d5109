"""Catalog tables, files and rows in; tables out; schema listings.  (A1-A3, A5, A6)"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TEXT, i > 0) for i, n in enumerate(names)])


# Schemas of the dimension files: ids first, zip codes stay text.
DIMENSION_SCHEMAS = {
    "item_details": _strings("item_id", "item_name", "item_description"),
    "store_location": _strings("location_id", "location_name", "location_description"),
    "customer_details": _strings("customer_id", "customer_name", "customer_email", "customer_zip_code"),
}


def load_table(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """A1: a catalog table, or ``{root}/{name}.parquet`` when a folder is given."""
    return spark.read.parquet(f"{root}/{name}.parquet") if root else spark.table(name)


def load_csv_dimension(
    spark: SparkSession, path: str, schema: T.StructType | None = None, table: str | None = None
) -> DataFrame:
    """A2: a dimension file with a header and quoted commas, read with an explicit schema."""
    schema = schema if schema is not None else DIMENSION_SCHEMAS[table]
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', mode="FAILFAST")


def write_csv(df: DataFrame, path: str) -> None:
    """Counterpart of A2."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def rows_to_table(
    spark: SparkSession, rows: Iterable, schema: T.StructType | Sequence[str] | str
) -> DataFrame:
    """A3: literal rows with an explicit schema, or with names only and inferred types."""
    return spark.createDataFrame(list(rows), schema=schema)


def save_table(
    df: DataFrame,
    name: str | None = None,
    path: str | None = None,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    max_rows_per_file: int = 20_000_000,
) -> None:
    """A5: write a managed table or a parquet folder; overwriting also replaces the schema.

    With ``partition_by`` the rows of a value are gathered before they are written, so that a value has few files and
    not one from every task.  Adaptive execution sizes the writing tasks
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``): small values share a task, a hot value is split
    over many.  A file has at most ``max_rows_per_file`` rows.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format("parquet").option("maxRecordsPerFile", max_rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path is not None:
        writer.save(path)
    else:
        writer.saveAsTable(name)


def catalog_tables(spark: SparkSession, namespace: str | None = None) -> dict[str, DataFrame]:
    """Every table of a schema by name."""
    prefix = f"{namespace}." if namespace else ""
    return {
        t.name: spark.table(t.name if t.isTemporary else prefix + t.name)
        for t in spark.catalog.listTables(namespace)
    }


def folder_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every ``{name}.parquet`` below a folder by name, as the folder's own file system lists it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in listed)
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{root}/{n}") for n in names if n.endswith(".parquet")}


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: table_name, position, col_name, data_type.

    Reads schemas only, so its size is that of the catalog, not of the data.
    """
    rows = [
        (name, pos, f.name, f.dataType.simpleString())
        for name, df in tables.items()
        for pos, f in enumerate(df.schema.fields, 1)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        rows, "table_name string, position bigint, col_name string, data_type string"
    )


def profile_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and non-null values per column, one scan per table, one output row per column."""
    parts = []
    for name, df in tables.items():
        counts = df.agg(
            F.count(F.lit(1)).alias("__rows"),
            *[F.count(F.col(c)).alias(c) for c in df.columns],
        )
        entries = [
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(c).alias("col_name"),
                F.col("__rows").alias("row_count"),
                F.col(c).alias("non_null"),
            )
            for c in df.columns
        ]
        parts.append(counts.select(F.inline(F.array(*entries))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
