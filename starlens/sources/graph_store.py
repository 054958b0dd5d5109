"""Saved graphs: nodes, edges and embeddings as parquet folders.  (A8)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starlens.sources.tables import save_table

PARTS = ("nodes", "edges", "embeddings")


def save_graph(path: str, nodes: DataFrame, edges: DataFrame, embeddings: DataFrame) -> None:
    """Each part is written by all tasks in parallel; edges are split by the tables they link."""
    save_table(nodes, path=f"{path}/nodes")
    save_table(edges, path=f"{path}/edges", partition_by=["src_table", "dst_table"])
    save_table(embeddings, path=f"{path}/embeddings")


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three parts by name; an edge filter on its tables prunes folders."""
    return {part: spark.read.parquet(f"{path}/{part}") for part in PARTS}
