"""Pairs dealt out into pieces: their number follows the bytes read, and ends that are null or equal are counted as before."""

from collections import Counter

from starlens.joins import dealt
from starlens.operators import graph as gr


def test_pieces_follow_the_bytes_read(spark, tmp_path):
    spark.range(20_000).selectExpr("id as a", "id * 7 % 1000 as b").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    few, many = (dealt(rows, "a", piece=piece).rdd.getNumPartitions() for piece in (1 << 40, 1 << 10))
    assert few == spark.sparkContext.defaultParallelism < many
    assert dealt(rows, "a", piece=1 << 10).count() == 20_000
    unsized = spark.createDataFrame(spark.sparkContext.parallelize([(1, 2)]), "a long, b long")
    assert dealt(unsized, "a").count() == 1


def test_degree_and_adjacency_of_awkward_ends(spark):
    rows = [("a", "b", 2), ("b", "a", 1), ("a", "b", 1), ("c", "c", 3), (None, "a", 1), ("a", None, 5), (None, None, 1)]
    edges = spark.createDataFrame(rows, "src_id string, dst_id string, edges long")
    ends = [(x, y, n) for a, b, n in rows for x, y in ((a, b), (b, a))]
    got = gr.adjacency(edges).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(x, y) for x, y, _ in ends}
    degree, met = Counter(), {}
    for x, y, n in ends:
        degree[x] += n
        met.setdefault(x, set()).add(y)
    assert {tuple(r) for r in gr.degree(edges).collect()} == {(x, degree[x], len(met[x])) for x in met}
