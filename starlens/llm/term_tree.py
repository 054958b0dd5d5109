"""Ranked lexical search: documents in an FP-tree, items answered by branch and bound.

A document keeps only the terms that some item asks for, the most frequent first.  Sorted, these vectors are a trie:
documents with equal beginnings share a path and stand side by side, so a subtree is a range of documents.  A node
knows the largest tf of each term and the smallest m below it, which bound every score in the subtree.
Each item descends depth first, the best child first, and leaves out what its tenth score so far rules out.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from starlens.llm.common import as_bytes, by_value, stored, texts_of

by_value(__name__)

RANKS = 10
#: Bytes of item text that tasks hold at once; more items are searched in several blocks.
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 4 << 20
#: Documents that are scored together instead of being branched further; they make a leaf.
LEAF = 128
#: Levels of a tree; below the last one stand leaves, whatever their size.
LEVELS = 24
#: Occurrences of terms in one tree, unless a single document has more.
TREE_ENTRIES = 2 << 20

# Lower-cases A-Z; every other ASCII byte but 0-9 and a-z is a gap.
_NORMAL = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(text: bytes | None, known: dict[bytes, int] | None = None) -> tuple[int, Counter]:
    """Number of terms with repeats, and the occurrences of each (of the ``known`` only, under their number)."""
    text, at, n, found = text or b"", 0, 0, Counter()
    while at < len(text):
        end = min(at + PIECE_BYTES, len(text))
        while end < len(text) and _NORMAL[text[end]] != 32:
            end += 1
        terms = text[at:end].translate(_NORMAL).split()
        n += len(terms)
        counts = Counter(terms)
        if known is None:
            found.update(counts)
        else:
            for term in counts.keys() & known.keys():
                found[known[term]] += counts[term]
        at = end
    return n, found


def _slices(keys: np.ndarray, width: int, terms: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``keys`` (term * width + position) with low <= position < high, and which term each is of."""
    a = np.searchsorted(keys, terms * width + low)
    n = np.searchsorted(keys, terms * width + high) - a
    of = np.repeat(np.arange(len(terms)), n)
    return np.arange(len(of)) + np.repeat(a - np.cumsum(n) + n, n), of


def _largest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each key, in order of the keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[heads], np.maximum.reduceat(values[order], heads) if len(heads) else values


class Tree:
    """FP-tree over documents: ``ids``, ``m``, and per document ``sizes`` terms (by frequency, 0 the highest) with tf."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(ids)), sizes)
        inside = np.lexsort((terms, owner))
        terms, tf = terms[inside], tf[inside]
        first = np.concatenate([[0], np.cumsum(sizes)])
        big = terms.astype(">u4")
        paths = [big[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        order = sorted(range(len(ids)), key=lambda i: (paths[i], ids[i]))
        self.ids, self.m = ids[order], m[order]
        self.size = len(ids)
        place = np.empty(self.size, np.int64)
        place[order] = np.arange(self.size)
        position = place[owner]
        self._branch([terms[first[i] : first[i + 1]] for i in order])
        keys = terms.astype(np.int64) * self.size + position
        by_key = np.argsort(keys)
        self.doc_keys, self.doc_tf = keys[by_key], tf[by_key]
        self._bound(position, terms.astype(np.int64), tf)

    def _branch(self, paths: list[np.ndarray]) -> None:
        """Nodes as ranges of documents; small neighbours under one parent are one leaf."""
        shared = np.zeros(self.size, np.int64)
        for i in range(1, self.size):
            n = min(len(paths[i - 1]), len(paths[i]))
            other = paths[i - 1][:n] != paths[i][:n]
            shared[i] = other.argmax() if other.any() else n
        low, high, level, parent, kids = [0], [self.size], [0], [-1], [(0, 0)]
        at = 0
        while at < len(low):
            a, b = low[at], high[at]
            if b - a > LEAF and level[at] < LEVELS:
                inner = shared[a + 1 : b]
                cuts = [a, *(np.flatnonzero(inner == inner.min()) + a + 1).tolist(), b]
                start = len(low)
                begin = a
                for here, there in zip(cuts[1:-1], cuts[2:]):
                    if there - begin > LEAF:
                        low.append(begin), high.append(here)
                        begin = here
                low.append(begin), high.append(b)
                made = len(low) - start
                level += [level[at] + 1] * made
                parent += [at] * made
                kids += [(0, 0)] * made
                kids[at] = (start, len(low))
            at += 1
        self.low, self.high, self.kids = low, high, kids
        self.level, self.parent = np.array(level), np.array(parent)

    def _bound(self, position: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """Largest tf of each term, smallest m and smallest id of each node, from the leaves upwards."""
        nodes = len(self.low)
        self.nodes = nodes
        self.least_m, self.least_id = np.empty(nodes, np.int64), np.empty(nodes, np.int64)
        leaf_of = np.empty(self.size, np.int64)
        for x in range(nodes):
            of = slice(self.low[x], self.high[x])
            self.least_m[x], self.least_id[x] = self.m[of].min(), self.ids[of].min()
            if self.kids[x] == (0, 0):
                leaf_of[of] = x
        leaf = leaf_of[position]
        depth = self.level[leaf]
        made, up = [], (np.empty(0, np.int64), np.empty(0, np.int64))
        for level in range(int(self.level.max()), -1, -1):
            here = depth == level
            keys = np.concatenate([terms[here] * nodes + leaf[here], up[0]])
            keys, most = _largest(keys, np.concatenate([tf[here], up[1]]))
            made.append((keys, most))
            up = keys // nodes * nodes + self.parent[keys % nodes], most
        keys, most = (np.concatenate([part[i] for part in made]) for i in (0, 1))
        order = np.argsort(keys)
        self.node_keys, self.node_tf = keys[order], most[order]

    def scores(self, terms: np.ndarray, weights: np.ndarray, low: int, high: int, of_nodes: bool) -> np.ndarray:
        """Scores of the documents low..high, or bounds for the nodes low..high."""
        keys, tf, m, width = (
            (self.node_keys, self.node_tf, self.least_m, self.nodes)
            if of_nodes
            else (self.doc_keys, self.doc_tf, self.m, self.size)
        )
        at, which = _slices(keys, width, terms, low, high)
        position = keys[at] - terms[which] * width
        tf = tf[at]
        sums = np.zeros(high - low, np.int64)
        np.add.at(sums, position - low, weights[which] * (1_000_000_000 * tf // (1000 * tf + 8 * m[position])))
        return sums

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Adds the documents of the tree to ``best``; the number of documents scored."""
        stack, scored = [(best.unbounded, -1, 0)], 0
        while stack:
            bound, least_id, x = stack.pop()
            if not best.may_hold(bound, least_id):
                continue
            if self.kids[x] == (0, 0):
                a, b = self.low[x], self.high[x]
                best.add(self.scores(terms, weights, a, b, False), self.ids[a:b])
                scored += b - a
                continue
            a, b = self.kids[x]
            bounds, ids = self.scores(terms, weights, a, b, True), self.least_id[a:b]
            hopeful = np.flatnonzero(best.may_hold(bounds, ids))
            for k in hopeful[np.lexsort((-ids[hopeful], bounds[hopeful]))].tolist():
                stack.append((int(bounds[k]), int(ids[k]), a + k))
        return scored


class Best:
    """The highest scores so far of one item; of equal ones the smallest id."""

    unbounded = np.iinfo(np.int64).max

    def __init__(self, ranks: int) -> None:
        self.ranks, self.scores, self.ids = ranks, np.empty(0, np.int64), np.empty(0, np.int64)

    def may_hold(self, bound, least_id):
        """Whether a score of ``bound`` with that id would be among the best."""
        if len(self.scores) < self.ranks:
            return bound > 0
        return (bound > self.scores[-1]) | ((bound == self.scores[-1]) & (least_id < self.ids[-1]))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        of = np.flatnonzero(self.may_hold(scores, ids))
        if len(of):
            scores, ids = np.concatenate([self.scores, scores[of]]), np.concatenate([self.ids, ids[of]])
            order = np.lexsort((ids, -scores))[: self.ranks]
            self.scores, self.ids = scores[order], ids[order]


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Items as (id, text) in blocks of about ``block_bytes`` of text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    items = benchmark.select("item_id", text)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [(r.item_id, r.text.encode()) for r in items.filter(block == b).collect()]


def _restricted(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of the documents with a term; only known terms are listed, by their number."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def kernel(batches):
        known = shared.value
        for batch in batches:
            keep, ns, firsts, terms, tf = [], [], [0], [], []
            for text in as_bytes(batch.column("text")):
                n, found = term_counts(text, known)
                keep.append(n > 0)
                if n:
                    ns.append(n)
                    terms += found.keys()
                    tf += found.values()
                    firsts.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), x) for x in (pa.array(terms, pa.int32()), pa.array(tf, pa.int64())))
            ids = batch.column("doc_id").filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(kernel, "doc_id long, n long, terms array<int>, tf array<long>")


def _search(docs: DataFrame, items: list, kind, ranks: int) -> DataFrame:
    """Best documents of each task for each of ``items``: (item, item_id, doc_id, score)."""
    spark = docs.sparkSession
    wanted = [term_counts(text)[1] for _, text in items]
    names = sorted(set().union(*wanted))
    vectors = stored(_restricted(docs, {t: i for i, t in enumerate(names)}))
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    by_frequency = sorted(df, key=lambda t: (-df[t], t))
    number = np.zeros(len(names), np.int64)
    number[by_frequency] = np.arange(len(by_frequency))
    at = {names[t]: k for k, t in enumerate(by_frequency)}
    weight = {t: math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df[t] + 1))) for t in by_frequency}
    asked = []
    for (item_id, _), counts in zip(items, wanted):
        terms = sorted((at[t], weight[by_frequency[at[t]]] * n) for t, n in counts.items() if t in at)
        asked.append((item_id, np.array([t for t, _ in terms], np.int64), np.array([w for _, w in terms], np.int64)))
    shared = spark.sparkContext.broadcast((number, asked, total.docs, total.terms))
    id_type = to_arrow_type(kind)

    def kernel(batches):
        number, asked, n_docs, n_terms = shared.value
        best = [Best(ranks) for _ in asked]
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            m = np.array([25 + 75 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], np.int64)
            lists, tf = batch.column("terms"), batch.column("tf").flatten().to_numpy()
            terms, first = number[lists.flatten().to_numpy()], lists.offsets.to_numpy().astype(np.int64)
            first = first - first[0]
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(first, first[a] + TREE_ENTRIES, side="right")) - 1)
                of = slice(first[a], first[b])
                tree = Tree(ids[a:b], m[a:b], np.diff(first[a : b + 1]), terms[of], tf[of])
                for (_, wanted, weights), found in zip(asked, best):
                    if len(wanted):
                        tree.search(wanted, weights, found)
                a = b
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            item = np.repeat(np.arange(len(best)), sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(item, pa.int64()),
                    pa.array([asked[i][0] for i in item], id_type),
                    pa.array(np.concatenate([b.ids for b in best])),
                    pa.array(np.concatenate([b.scores for b in best])),
                ],
                names=["item", "item_id", "doc_id", "score"],
            )

    schema = f"item long, item_id {kind.simpleString()}, doc_id long, score long"
    return vectors.filter("doc_id is not null and size(terms) > 0").mapInArrow(kernel, schema)


def ranked_search(docs: DataFrame, benchmark: DataFrame, ranks: int = RANKS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``ranks`` best documents of each item with a score above 0.

    Terms are runs of 0-9, letters and bytes from 0x80 on, A-Z lower-cased.  Equal scores rank by ``doc_id``.

    Null and empty texts have no terms, so they are never found and count for nothing.  A document without id counts in
    all statistics but can't be named, so it is never returned.  Each row of ``docs`` is a document and each row of
    ``benchmark`` an item, repeated rows and null ids too.  An empty table gives no rows.  Other columns are not read.
    The benchmark is the query set: tasks hold it in blocks of about ``block_bytes`` of text, one pass for each.
    """
    docs = texts_of(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    kind = benchmark.schema["item_id"].dataType
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    found = None
    for items in _blocks(benchmark, block_bytes):
        rows = _search(docs, items, kind, ranks).withColumn("rank", F.row_number().over(best))
        rows = rows.filter(F.col("rank") <= ranks).select("item_id", "rank", "doc_id", "score")
        found = rows if found is None else found.unionByName(rows)
    return found
