"""The star as a property multigraph of node and edge tables.  (B1-B12)

Nodes are dimension rows; every fact row links each pair of its dimension members.  Adjacency is
deduplicated map-side before it is shuffled, and every step of a walk joins it with the frontier
through :func:`lookup_join`, which spreads a node with very many neighbours over several tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions.text import describe_row
from starlens.joins import SALTS, dealt, lookup_join
from starlens.session import cut_lineage

HIDDEN = ("node_id", "node_table", "node_key", "node_text")


def node_id(table: str, key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{table}_"), key.cast("string"))


def build_nodes(
    dims: Mapping[str, DataFrame], keys: Mapping[str, str] | None = None, sep: str = " | "
) -> DataFrame:
    """One node per dimension row, keyed by the first column unless ``keys`` names another.

    Columns: node_id, node_table, node_key, node_text, then all attributes of all dimensions.
    """
    out = None
    for table, df in dims.items():
        key = (keys or {}).get(table, df.columns[0])
        part = df.select(
            node_id(table, key).alias("node_id"),
            F.lit(table).alias("node_table"),
            F.col(key).cast("string").alias("node_key"),
            describe_row(df.columns, sep).alias("node_text"),
            *df.columns,
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _endpoints(fact: DataFrame, mapping: Mapping[str, str], dims: Mapping[str, DataFrame] | None):
    """The fact with existence flags joined on, the foreign keys it has, and their conditions."""
    used = {fk: table for fk, table in mapping.items() if fk in fact.columns}
    rows = fact
    exists = {fk: F.col(fk).isNotNull() for fk in used}
    for i, (fk, table) in enumerate(used.items()):
        if dims is not None and table in dims:
            members = dims[table]
            flag = f"__has_{i}"
            known = members.select(F.col(members.columns[0]).alias(fk)).distinct()
            rows = lookup_join(rows, known.withColumn(flag, F.lit(True)), fk, "left", salts=SALTS)
            exists[fk] = F.coalesce(F.col(flag), F.lit(False))
    return rows, used, exists


def build_edges(
    fact: DataFrame, mapping: Mapping[str, str], dims: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """For each fact row one edge per pair of its foreign keys, in mapping order.

    ``mapping`` is foreign-key column -> dimension table; columns the fact lacks are skipped and a
    null key links nothing.  With ``dims`` (table -> dimension keyed by its first column) an edge
    needs both ends to exist.  Parallel edges are kept and carry the fact's columns.
    """
    rows, used, exists = _endpoints(fact, mapping, dims)
    pairs = [
        F.when(
            exists[a] & exists[b],
            F.struct(
                node_id(used[a], a).alias("src_id"),
                node_id(used[b], b).alias("dst_id"),
                F.lit(used[a]).alias("src_table"),
                F.lit(used[b]).alias("dst_table"),
            ),
        )
        for a, b in combinations(used, 2)
    ]
    return rows.select(F.explode(F.array_compact(F.array(*pairs))).alias("e"), *fact.columns).select(
        "e.*", *fact.columns
    )


def linked_pairs(
    fact: DataFrame, mapping: Mapping[str, str], dims: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """The edges of :func:`build_edges` counted per (src_id, dst_id), without writing them out.

    Sales are counted per pair of raw keys; ids are spelled out afterwards, once per pair.  Neighbourhood and degree questions need no more than this.
    """
    rows, used, exists = _endpoints(fact, mapping, dims)
    kinds = {fact.schema[fk].dataType.simpleString() for fk in used}
    kind = kinds.pop() if len(kinds) == 1 else "string"
    combos = list(combinations(used, 2))
    ends = [
        F.when(
            exists[a] & exists[b],
            F.struct(F.lit(i).alias("pair"), F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")),
        )
        for i, (a, b) in enumerate(combos)
    ]
    # Most pairs are few sales: they are counted after the shuffle only, in pieces that no task needs much memory for.
    counted = (
        dealt(rows.select(F.inline(F.array_compact(F.array(*ends)))), "pair", "a", "b")
        .groupBy("pair", "a", "b")
        .agg(F.count(F.lit(1)).alias("edges"))
    )

    def named(side: int) -> Column:
        return F.get(F.array(*[F.lit(used[c[side]]) for c in combos]), F.col("pair"))

    named_pairs = counted.select(
        F.concat(named(0), F.lit("_"), F.col("a").cast("string")).alias("src_id"),
        F.concat(named(1), F.lit("_"), F.col("b").cast("string")).alias("dst_id"),
        named(0).alias("src_table"),
        named(1).alias("dst_table"),
        "edges",
    )
    linked = [frozenset((used[a], used[b])) for a, b in combos]
    if len(set(linked)) == len(linked):
        return named_pairs
    # Two foreign keys lead to one table: the same pair of nodes can come from several columns.
    return named_pairs.groupBy("src_id", "dst_id", "src_table", "dst_table").agg(F.sum("edges").alias("edges"))


def node_attributes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes whose ``node_id`` is in ``ids``."""
    return nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi")


def _both_ways(pairs: DataFrame, *extra: str) -> DataFrame:
    ends = F.array(
        F.struct(F.col("src_id").alias("node_id"), F.col("dst_id").alias("neighbor_id"), *extra),
        F.struct(F.col("dst_id").alias("node_id"), F.col("src_id").alias("neighbor_id"), *extra),
    )
    return pairs.select(F.inline(ends))


def _undirected(edges: DataFrame, *extra: str) -> DataFrame:
    """(lo, hi, extra) of ``edges``, dealt out by both ends; a null end is ``lo``."""
    ordered = F.col("src_id").isNull() | (F.col("src_id") <= F.col("dst_id"))
    lo, hi = (F.when(ordered, F.col(x)).otherwise(F.col(y)) for x, y in (("src_id", "dst_id"), ("dst_id", "src_id")))
    return dealt(edges.select(lo.alias("lo"), hi.alias("hi"), *extra), "lo", "hi")


def _either_end(pairs: DataFrame, *extra: str) -> DataFrame:
    """(node_id, neighbor_id, extra) for both ends of distinct (lo, hi, extra); a node linked to itself once."""
    one = F.struct(F.col("lo").alias("node_id"), F.col("hi").alias("neighbor_id"), *extra)
    other = F.struct(F.col("hi").alias("node_id"), F.col("lo").alias("neighbor_id"), *extra)
    same = F.col("lo").eqNullSafe(F.col("hi"))
    return pairs.select(F.inline(F.when(same, F.array(one)).otherwise(F.array(one, other))))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbour pairs (node_id, neighbor_id) of any edge table.

    An edge is shuffled and made distinct once, not once for each direction.
    """
    return _either_end(_undirected(edges).distinct())


def adjacency_of(
    fact: DataFrame, mapping: Mapping[str, str], dims: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """The same pairs straight from the fact, deduplicated on raw keys."""
    pairs = linked_pairs(fact, mapping, dims)
    tables = [t for fk, t in mapping.items() if fk in fact.columns]
    both = _both_ways(pairs)
    return both if len(set(tables)) == len(tables) else both.distinct()


def neighbors(adj: DataFrame, ids: DataFrame) -> DataFrame:
    """Neighbour pairs of the given nodes."""
    return lookup_join(adj, ids.select("node_id").distinct(), "node_id", "left_semi", salts=SALTS)


def expand_context(adj: DataFrame, seeds: DataFrame, max_hops: int = 2) -> DataFrame:
    """Every node within ``max_hops`` of a seed, with its smallest hop; seeds are always kept.

    Walks of more than two hops checkpoint after each further hop and stop at an empty frontier.
    """
    visited = seeds.select("node_id").distinct().withColumn("hop", F.lit(0).cast("bigint"))
    frontier = visited
    for hop in range(1, max_hops + 1):
        reached = neighbors(adj, frontier).select(F.col("neighbor_id").alias("node_id")).distinct()
        frontier = reached.join(visited.select("node_id"), "node_id", "left_anti").withColumn(
            "hop", F.lit(hop).cast("bigint")
        )
        if hop >= 2 and hop < max_hops:
            frontier = cut_lineage(frontier)
            if frontier.isEmpty():
                break
        visited = visited.unionByName(frontier)
    return visited


#: Keys of one table that travel into the scan as a list; more are joined.
PUSHED_KEYS = 2000


def _member_keys(ids: DataFrame, mapping: Mapping[str, str], fact: DataFrame) -> DataFrame:
    """``ids`` with a column per foreign key of the fact: the raw key, in its type, if the node is of its table."""
    out = ids.select("node_id")
    for fk, table in mapping.items():
        if fk in fact.columns:
            raw = F.expr(f"substring(node_id, {len(table) + 2})").try_cast(fact.schema[fk].dataType)
            # A key is a member only if it spells the same node ("01" is not 1).
            out = out.withColumn(fk, F.when(F.col("node_id") == node_id(table, raw), raw))
    return out


class _Members:
    """Nodes as raw keys of the fact: lists while they are few, else tables to join with."""

    def __init__(self, ids: DataFrame, mapping: Mapping[str, str], fact: DataFrame, pushed: int) -> None:
        keys = _member_keys(ids, mapping, fact)
        self.fks = keys.columns[1:]
        rows = keys.limit(pushed + 1).collect()
        self.keys = None if len(rows) > pushed else {fk: [r[fk] for r in rows if r[fk] is not None] for fk in self.fks}
        self.ids = keys if self.keys is None else ids.sparkSession.createDataFrame([(r.node_id,) for r in rows], "node_id string")

    def rows_with(self, fact: DataFrame, fk: str) -> DataFrame | None:
        """Rows of the fact whose ``fk`` is a member; few keys reach the scan as a filter; ``None`` if there are none."""
        if self.keys is not None:
            return fact.filter(F.col(fk).isin(self.keys[fk])) if self.keys[fk] else None
        wanted = self.ids.select(fk).na.drop().distinct()
        return lookup_join(fact, wanted, fk, "left_semi", salts=SALTS).select(*fact.columns)


def expand_facts(
    fact: DataFrame, mapping: Mapping[str, str], seeds: DataFrame, max_hops: int = 2, pushed: int = PUSHED_KEYS
) -> DataFrame:
    """B8 straight from the fact: (node_id, hop) of every node within ``max_hops`` of a seed; seeds are always kept.

    No adjacency is built.  Each hop reads the fact once per foreign key that the frontier has, restricted to the
    frontier's raw keys: up to ``pushed`` nodes are a filter of the scan, more a semi-join with a checkpointed
    frontier.  The rows' other keys are the neighbours.  An empty frontier ends the walk.
    """
    frontier = seeds.select("node_id").distinct()
    visited = None
    for hop in range(max_hops + 1):
        at = F.lit(hop).cast("bigint").alias("hop")
        if hop == max_hops:
            return frontier.select("node_id", at) if visited is None else visited.unionByName(frontier.select("node_id", at))
        members = _Members(frontier, mapping, fact, pushed)
        if members.keys is None:
            frontier = cut_lineage(frontier)
            members.ids = _member_keys(frontier, mapping, fact)
        else:
            frontier = members.ids
        here = frontier.select("node_id", at)
        visited = here if visited is None else visited.unionByName(here)
        reached = None
        for fk in members.fks:
            rows = members.rows_with(fact, fk)
            others = [k for k in members.fks if k != fk]
            if rows is not None and others:
                linked = [F.when(F.col(k).isNotNull(), node_id(mapping[k], k)) for k in others]
                part = rows.select(F.explode(F.array_compact(F.array(*linked))).alias("node_id")).distinct()
                reached = part if reached is None else reached.unionByName(part)
        if reached is None:
            return visited
        frontier = reached.distinct().join(visited.select("node_id"), "node_id", "left_anti")


def induced_facts(
    fact: DataFrame,
    mapping: Mapping[str, str],
    node_set: DataFrame,
    pushed: int = PUSHED_KEYS,
    links: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """B9 straight from the fact: :func:`build_edges` restricted to edges with both ends in ``node_set``.

    Each pair of foreign keys is a scan restricted to the members' raw keys of both, as in :func:`expand_facts`.
    ``links`` names the (source, destination) tables whose edges are wanted; other pairs are not read.
    """
    members = _Members(node_set.select("node_id").distinct(), mapping, fact, pushed)
    out = None
    for a, b in combinations(members.fks, 2):
        if links is not None and (mapping[a], mapping[b]) not in links:
            continue
        rows = members.rows_with(fact, a)
        rows = None if rows is None else members.rows_with(rows, b)
        if rows is not None:
            part = build_edges(rows, {a: mapping[a], b: mapping[b]})
            out = part if out is None else out.unionByName(part)
    return build_edges(fact.limit(0), mapping) if out is None else out


def induced_subgraph(edges: DataFrame, node_set: DataFrame) -> DataFrame:
    """The edges with both ends in ``node_set``."""
    inside = node_set.select("node_id").distinct()
    by_source = lookup_join(
        edges, inside.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi", salts=SALTS
    )
    return lookup_join(
        by_source, inside.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi", salts=SALTS
    ).select(*edges.columns)


def subgraph_size(edges: DataFrame, node_set: DataFrame) -> DataFrame:
    """One row with the number of nodes and edges of the induced subgraph."""
    return sizes_of(induced_subgraph(edges, node_set), node_set)


def sizes_of(inner: DataFrame, node_set: DataFrame) -> DataFrame:
    """One row with the number of nodes in ``node_set`` and of the edges between them."""
    inside = node_set.select("node_id").distinct().agg(F.count(F.lit(1))).scalar()
    return inner.agg(F.count(F.lit(1)).alias("edges")).select(
        inside.alias("nodes"), "edges"
    )


def subgraph_facts(edges: DataFrame, src_table: str, dst_table: str, value: str, units: str) -> DataFrame:
    """Purchases in a context per (destination, source) with subtotals per destination and overall.

    The finest level is summed first; the rollup then triples only those sums.  ``level`` is 0 for
    lines, 1 for a destination's total, 3 for the grand total.
    """
    lines = (
        edges.filter((F.col("src_table") == src_table) & (F.col("dst_table") == dst_table))
        .groupBy("dst_id", "src_id")
        .agg(F.sum(value).alias("v"), F.sum(units).alias("u"), F.count(F.lit(1)).alias("n"))
    )
    return lines.rollup("dst_id", "src_id").agg(
        F.sum("v").alias("value"),
        F.sum("u").alias("units"),
        F.sum("n").alias("purchases"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def node_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per dimension table."""
    return nodes.groupBy("node_table").agg(F.count(F.lit(1)).alias("nodes"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges per pair of tables."""
    return edges.groupBy("src_table", "dst_table").agg(F.count(F.lit(1)).alias("edges"))


def graph_statistics(
    nodes: DataFrame,
    edges: DataFrame,
    embedded: DataFrame,
    tables: Sequence[str],
    fact: str,
    vector: str = "embedding",
) -> DataFrame:
    """One row with node and edge totals, embedding size, dimension names and fact name."""
    total_edges = edges.agg(F.count(F.lit(1))).scalar()
    dims = embedded.agg(F.max(F.size(vector)).cast("bigint")).scalar()
    return nodes.agg(F.count(F.lit(1)).alias("total_nodes")).select(
        "total_nodes",
        total_edges.alias("total_edges"),
        dims.alias("embedding_dim"),
        F.lit(", ".join(tables)).alias("dimension_tables"),
        F.lit(fact).alias("fact_table"),
    )


def degree(pairs: DataFrame) -> DataFrame:
    """Relationships and distinct neighbours of each node, from :func:`linked_pairs`.

    Parallel edges were counted per pair, so a hub adds one row per neighbour, not per sale.
    """
    twice = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.sum("edges") * 2).otherwise(F.sum("edges"))
    both = _either_end(_undirected(pairs, "edges").groupBy("lo", "hi").agg(twice.alias("edges")), "edges")
    return both.groupBy("node_id").agg(F.sum("edges").alias("degree"), F.count(F.lit(1)).alias("neighbors"))
