"""Exact top-k search by inner product: a table of distances to pivots gives bounds, the best bounds are evaluated first.

Every candidate x gets one more component, sqrt(M^2 - |x|^2), that makes all candidates equally long (M, the greatest
length); queries get a 0 there.  Then the greatest inner product is the smallest distance, and for any pivot p the
distance of q and x is at least |d(q, p) - d(x, p)|.  The maximum over all pivots bounds the inner product from above.
Blocks of neighbouring candidates are left out as a whole by the ranges of their distances.  In the others the
candidates come in order of their bounds until the next bound is below the score of the last rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.llm.common import by_value, partitions, stored

by_value(__name__)

RANKS = 5
SCALE = 256
PIVOTS = 64
#: Rows from which pivots are chosen.  Any pivots give the same results; only the work differs.
PIVOT_SAMPLE = 1024
#: Bytes of queries that tasks hold at once; more are searched in several passes.
QUERY_BYTES = 16 << 20
BLOCK_ROWS = 2048
_FIRST_STEP = 64


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; only rows with id and without null or non-finite components."""
    x = F.col("embedding")
    fit = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(math.inf)))
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
        .filter(F.col("vec_id").isNotNull() & x.isNotNull() & fit)
        .select("vec_id", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))
    )


def choose_pivots(rows: np.ndarray, longest: int, count: int) -> np.ndarray:
    """Rows far from each other: the first, then always the one farthest from those chosen."""
    chosen = [0]
    gaps = distances(rows, rows[:1], longest)[:, 0]
    while len(chosen) < min(count, len(rows)) and gaps.max() > 0:
        chosen.append(int(gaps.argmax()))
        gaps = np.minimum(gaps, distances(rows, rows[chosen[-1:]], longest)[:, 0])
    return rows[chosen]


def _lift(rows: np.ndarray, longest: int) -> np.ndarray:
    x = rows.astype(np.float64)
    return np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))


def distances(rows: np.ndarray, pivots: np.ndarray, longest: int, lifted: bool = True) -> np.ndarray:
    """Distances of rows (made equally long if ``lifted``) and pivots; ``longest`` is the greatest squared length."""
    x, p = rows.astype(np.float64), pivots.astype(np.float64)
    inner = x @ p.T
    if lifted:
        return np.sqrt(np.maximum(2.0 * longest - 2 * (inner + np.outer(_lift(rows, longest), _lift(pivots, longest))), 0))
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + longest - 2 * inner, 0))


class Queries:
    """Queries with their distances to the pivots and their best candidates so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray, longest: int, ranks: int) -> None:
        self.ids, self.rows, self.longest, self.ranks = ids, rows, longest, ranks
        self.gaps = distances(rows, pivots, longest, lifted=False)
        self.square = (rows.astype(np.float64) ** 2).sum(axis=1)
        # Products below 2^53 are exact in doubles; longer vectors are multiplied as integers.
        exact = longest * max(1.0, float(self.square.max(initial=0))) < 2.0**104
        self.kind = np.float64 if exact else np.int64
        self.rows = rows.astype(self.kind)
        #: Covers the rounding of every distance and bound.
        self.slack = 1e-6 * math.sqrt(longest) + 1e-6 * np.sqrt(self.square) + 1e-6
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        self.evaluated = 0

    def bound(self, q, gap: np.ndarray) -> np.ndarray:
        """Greatest inner product at a distance of at least ``gap``."""
        gap = np.maximum(gap - self.slack[q], 0)
        return (self.square[q] + self.longest - gap * gap) / 2 + 1 + 1e-9 * (self.square[q] + self.longest)

    def last(self, q: int) -> float:
        """Score of the last rank; below every score while ranks are free."""
        scores = self.best[q][0]
        return scores[-1] if len(scores) == self.ranks else -math.inf

    def search(self, ids: np.ndarray, rows: np.ndarray, table: np.ndarray) -> None:
        """Offers a block of candidates, ``table`` being their distances to the pivots, to every query."""
        low, high = table.min(axis=0), table.max(axis=0)
        apart = np.maximum(np.maximum(low - self.gaps, self.gaps - high), 0).max(axis=1, initial=0)
        reach = self.bound(slice(None), apart)
        rows = rows.astype(self.kind)
        for q in range(len(self.ids)):
            if reach[q] >= self.last(q):
                self._search_one(q, ids, rows, table)

    def _search_one(self, q: int, ids: np.ndarray, rows: np.ndarray, table: np.ndarray) -> None:
        bounds = self.bound(q, np.abs(table - self.gaps[q]).max(axis=1, initial=0))
        order = np.flatnonzero((bounds >= self.last(q)) & (ids != self.ids[q]))
        order = order[np.argsort(-bounds[order], kind="stable")]
        at, step = 0, _FIRST_STEP
        while at < len(order) and bounds[order[at]] >= self.last(q):
            of = order[at : at + step]
            scores = (rows[of] @ self.rows[q]).astype(np.int64)
            fit = scores >= self.last(q)
            self.evaluated += len(of)
            if fit.any():
                scores = np.concatenate([self.best[q][0], scores[fit]])
                found = np.concatenate([self.best[q][1], ids[of][fit]])
                keep = np.lexsort((found, -scores))[: self.ranks]
                self.best[q] = scores[keep], found[keep]
            at, step = at + step, step * 2


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), size)


def _table(vectors: DataFrame, size: int, pivots: np.ndarray, longest: int) -> DataFrame:
    """Candidates with their distances to all pivots, neighbours side by side."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def kernel(batches):
        for batch in batches:
            gaps = distances(_rows(batch.column("v"), size), shared.value, longest).astype(np.float32)
            near = gaps.argmin(axis=1)
            first = pa.array(np.arange(len(gaps) + 1, dtype=np.int32) * gaps.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("v"),
                    pa.ListArray.from_arrays(first, pa.array(gaps.ravel())),
                    pa.array(near.astype(np.int32)),
                    pa.array(gaps[np.arange(len(gaps)), near]),
                ],
                names=["vec_id", "v", "gaps", "near", "gap"],
            )

    rows = vectors.mapInArrow(kernel, "vec_id long, v array<long>, gaps array<float>, near int, gap float")
    # Equal vectors are dealt by id, so a common vector has no task of its own.
    rows = rows.repartitionByRange(partitions(vectors.sparkSession), "near", "gap", "vec_id")
    return stored(rows.sortWithinPartitions("near", "gap", "vec_id").drop("near", "gap"))


def _pass(table: DataFrame, asked: list, size: int, pivots: np.ndarray, longest: int, ranks: int) -> DataFrame:
    """Best candidates of each task for one block of queries."""
    ids = np.array([r.vec_id for r in asked], np.int64)
    rows = np.array([r.v for r in asked], np.int64).reshape(len(asked), size)
    shared = table.sparkSession.sparkContext.broadcast((ids, rows, pivots))

    def kernel(batches):
        ids, rows, pivots = shared.value
        queries = Queries(ids, rows, pivots, longest, ranks)
        for batch in batches:
            found, v = batch.column("vec_id").to_numpy(), _rows(batch.column("v"), size)
            gaps = _rows(batch.column("gaps"), len(pivots))
            for a in range(0, len(found), BLOCK_ROWS):
                of = slice(a, a + BLOCK_ROWS)
                queries.search(found[of], v[of], gaps[of])
        for q, (scores, found) in enumerate(queries.best):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), q)), pa.array(np.full(len(scores), ids[q])), pa.array(found), pa.array(scores)],
                    names=["query", "query_id", "vec_id", "score"],
                )

    return table.mapInArrow(kernel, "query long, query_id long, vec_id long, score long")


def exact_top_k(
    queries: DataFrame,
    vectors: DataFrame,
    ranks: int = RANKS,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``ranks`` vectors with the greatest inner product for each query.

    Components become floor(scale * x); scores are whole numbers and have to fit 64 bits.  Equal scores rank by vec_id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without id, since they can't
    be named.  A row is known by its id: a query meets every row of another id.  Each row is a query or a candidate of its own,
    repeated rows too.  Vectors meet those of the same length only.  An empty table gives no rows.  Other columns
    are not read.  Queries are sent to the tasks in blocks of about ``query_bytes``, each against all rows.
    """
    spark = vectors.sparkSession
    rows, asked = whole_vectors(vectors, scale), whole_vectors(queries, scale)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("vec_id"))
    square = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, c: s + c * c)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.max(square).alias("longest"))
    wanted = {r["size"]: r["count"] for r in asked.groupBy(F.size("v").alias("size")).count().collect()}
    parts = []
    for size, longest in sorted(map(tuple, sizes.collect())):
        if size not in wanted:
            continue
        own = rows.filter(F.size("v") == size)
        sample = own.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).collect()
        sample = np.array([r.v for r in sample], np.int64).reshape(len(sample), size)
        chosen = choose_pivots(sample, longest, pivots)
        table = _table(own, size, chosen, longest)
        blocks = math.ceil(wanted[size] * 8 * (size + pivots) / query_bytes)
        for b in range(blocks):
            block = asked.filter((F.size("v") == size) & (F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b)).collect()
            found = _pass(table, block, size, chosen, longest, ranks).withColumn("rank", F.row_number().over(best))
            parts.append(found.filter(F.col("rank") <= ranks).select("query_id", "rank", "vec_id", "score"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
