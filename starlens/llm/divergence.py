"""Source divergence audit: how far the words of a source are from those of other sources of its language.

Words are counted as packed numbers.  A term of up to 8 bytes is one uint64, one of up to 16 bytes two; each
class is radix-sorted by 16-bit digits and its runs are counted.  Longer terms go to buckets of equal length that
are sorted as bytes.  Stable sorts keep the documents of a run in order, so the same pass counts documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.joins import SALTS, lookup_join
from starlens.llm.common import as_bytes, by_value, chunks, stored

by_value(__name__)

LEAST_DOCS = 3
RANKS = 200
PIECE_BYTES = 2 << 20
#: Runs that a task holds before they are summed up, and handed on when summing up doesn't halve them.
HELD_RUNS = 1 << 20
#: Counted terms and sources of one group of the pair sums.
BUCKET_ROWS = 100_000
SOURCES = 256
_CELLS = 1 << 20

# Lower-cases A-Z; every other ASCII byte but a-z is a gap, written as 0.
_NORMAL = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(256))


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by ``keys`` (uint64, the least significant first); equal rows stay as they stand."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, 64, 16):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if (digit != digit[:1]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_counts(keys: list[np.ndarray], order: np.ndarray, n: np.ndarray, docs: np.ndarray | None, text: np.ndarray | None):
    """Runs of equal ``keys`` in ``order``: their keys, sums of ``n``, and documents: summed, or changes of ``text``."""
    keys = [key[order] for key in keys]
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    heads = np.flatnonzero(new)
    if docs is None:
        text = text[order]
        docs = new.astype(np.int64)
        docs[1:] |= text[1:] != text[:-1]
    else:
        docs = docs[order]
    sums = (np.add.reduceat(a, heads) if len(heads) else a for a in (n[order], docs))
    return [key[heads] for key in keys], *sums


def _order(keys: list[np.ndarray]) -> np.ndarray:
    if keys[0].dtype.kind != "S":
        return radix_order(keys)
    order = np.argsort(keys[0], kind="stable")
    return order[radix_order([keys[1][order]])]


class Runs:
    """Counted terms of a task by class of length: 8 and 16 bytes packed, longer ones by their exact length.

    The keys of a class are its words, the last first, then the group.
    """

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple]] = {}
        self.held = 0

    def add(self, size: int, runs: tuple) -> None:
        self.parts.setdefault(size, []).append(runs)
        self.held += len(runs[1])

    def sum_up(self) -> None:
        """One run for each term and group."""
        self.held = 0
        for size, parts in self.parts.items():
            if len(parts) > 1:
                keys = [np.concatenate(k) for k in zip(*(p[0] for p in parts))]
                n, docs = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
                self.parts[size] = [run_counts(keys, _order(keys), n, docs, None)]
            self.held += len(self.parts[size][0][1])

    def count(self, texts: list[bytes], groups: np.ndarray) -> None:
        """Adds the terms of ``texts``; ``groups`` numbers the group of each text."""
        if sum(map(len, texts)) > 2 * PIECE_BYTES and len(texts) == 1:
            return self._count_long(texts[0], groups)
        data = (b" " + b" ".join(texts) + b" " * 16).translate(_NORMAL)
        letters = np.frombuffer(data, np.uint8) != 0
        edges = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(ends, starts, side="right")
        group = groups[text].astype(np.uint64)
        windows = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))

        def packed(at: np.ndarray, left: np.ndarray) -> np.ndarray:
            gap = ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
            return windows[at].astype(np.uint64) >> gap << gap

        for size, low, high in ((8, 1, 8), (16, 9, 16)):
            of = np.flatnonzero((lengths >= low) & (lengths <= high))
            if len(of):
                keys = [packed(starts[of], lengths[of]), group[of]]
                if size == 16:
                    keys.insert(0, packed(starts[of] + 8, lengths[of] - 8))
                self.add(size, run_counts(keys, _order(keys), np.ones(len(of), np.int64), None, text[of]))
        for size in np.unique(lengths[lengths > 16]).tolist():
            of = np.flatnonzero(lengths == size)
            keys = [np.array([data[s : s + size] for s in starts[of].tolist()], f"S{size}"), group[of]]
            self.add(size, run_counts(keys, _order(keys), np.ones(len(of), np.int64), None, text[of]))

    def _count_long(self, text: bytes, groups: np.ndarray) -> None:
        """One long text in pieces that end at gaps; it is one document all the same."""
        own, at = Runs(), 0
        while at < len(text):
            end = min(at + PIECE_BYTES, len(text))
            while end < len(text) and _NORMAL[text[end]]:
                end += 1
            own.count([text[at:end]], groups)
            own.sum_up()
            at = end
        for size, parts in own.parts.items():
            for keys, n, _ in parts:
                self.add(size, (keys, n, np.ones(len(n), np.int64)))

    def drain(self):
        """(group, terms, n, docs) of each class; nothing is held afterwards."""
        for size, parts in self.parts.items():
            for keys, n, docs in parts:
                if size > 16:
                    terms = pa.array(keys[0].tolist(), pa.binary())
                else:
                    flat = np.stack(keys[-2::-1], axis=1).astype(">u8").tobytes()
                    cells = np.frombuffer(flat, np.uint8).reshape(len(n), size)
                    ends = np.concatenate([[0], np.cumsum((cells != 0).sum(axis=1))]).astype(np.int32)
                    buffers = [None, pa.py_buffer(ends), pa.py_buffer(cells[cells != 0])]
                    terms = pa.Array.from_buffers(pa.binary(), len(n), buffers)
                yield keys[-1].astype(np.int64), terms, n, docs
        self.parts, self.held = {}, 0


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and documents of the group that hold it."""

    def kernel(batches):
        runs, codes, names = Runs(), {}, []

        def out():
            lang, source = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
            for group, terms, n, docs in runs.drain():
                for at in range(0, len(n), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [lang.take(group[part]), source.take(group[part]), terms[part], pa.array(n[part]), pa.array(docs[part])],
                        names=["lang", "source", "term", "n", "docs"],
                    )

        for batch in batches:
            texts = as_bytes(batch.column("text"))
            pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            groups = np.empty(len(texts), np.int64)
            for i, pair in enumerate(pairs):
                if pair not in codes:
                    codes[pair] = len(names)
                    names.append(pair)
                groups[i] = codes[pair]
            for a, b in chunks(texts, PIECE_BYTES):
                runs.count(texts[a:b], groups[a:b])
                if runs.held > HELD_RUNS:
                    runs.sum_up()
                    if runs.held > HELD_RUNS // 2:
                        yield from out()
        runs.sum_up()
        yield from out()

    found = docs.mapInArrow(kernel, "lang string, source string, term binary, n long, docs long")
    sums = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return sums.withColumn("term", F.col("term").cast("string"))


def _share(n: str, total: str) -> F.Column:
    """Exact 1 + floor(1000000000 * (n + 1) / total) beyond 64 bits."""
    return F.expr(
        f"1 + (cast(1000000000 as decimal(10,0)) * cast({n} + 1 as decimal(20,0))) div cast({total} as decimal(20,0))"
    )


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(terms: np.ndarray, sources: np.ndarray, p: np.ndarray, absent: np.ndarray, a0: int, a1: int) -> np.ndarray:
    """For sources a0..a1 (rows) against all (columns): the summed distances over some terms.

    ``terms``, ``sources`` and ``p`` list the terms that occur, ``absent`` has each source's p of a term that doesn't.
    Every pair starts as if no term occurred; then only the terms that one of the two has are looked at.
    """
    n_terms = int(terms.max()) + 1 if len(terms) else 0
    base = _distances(absent[a0:a1, None], absent[None])
    sums = n_terms * base
    order = np.argsort(terms, kind="stable")
    terms, sources, p = terms[order], sources[order], p[order]
    step = max(1, _CELLS // len(absent))
    for low in range(0, n_terms, step):
        rows = min(step, n_terms - low)
        of = slice(*np.searchsorted(terms, [low, low + rows]))
        table, has = np.tile(absent, (rows, 1)), np.zeros((rows, len(absent)), bool)
        table[terms[of] - low, sources[of]] = p[of]
        has[terms[of] - low, sources[of]] = True
        for a in range(a0, a1):
            own = table[has[:, a]]
            sums[a - a0] += (_distances(own[:, a, None], own) - base[a - a0]).sum(axis=0)
        for b in range(len(absent)):
            mine = has[:, b]
            others = _distances(absent[None, a0:a1], table[mine, b, None]) - base[None, :, b]
            sums[:, b] += np.where(has[mine, a0:a1], 0, others).sum(axis=0)
    return sums


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the pairs of sources of each language with kept terms.

    The terms of a language are dealt to buckets and its sources to blocks; a group is one bucket for one block.
    """
    langs = groups.groupBy("lang").agg(F.max("entries").alias("entries"), F.count("*").alias("sources"))
    langs = langs.filter("sources > 1").select(
        "lang",
        F.expr(f"1 + entries div {BUCKET_ROWS}").alias("buckets"),
        F.expr(f"explode(sequence(0L, (sources - 1) div {SOURCES}))").alias("block"),
    )
    named = [F.col(c).alias(c) for c in ("lang", "block")]  # the two sides of a cogroup share no column
    left = lookup_join(kept.select("lang", "source", "term", "p"), langs, "lang").select(
        *named, F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), "source", "term", "p"
    )
    right = lookup_join(groups.select("lang", "source", "absent"), langs, "lang").select(
        *named, F.expr("explode(sequence(0L, buckets - 1))").alias("bucket"), "source", "absent"
    )

    def kernel(key, entries, sources):
        names = sources.column("source").to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i].encode())
        names = [names[i] for i in order]
        a0 = key[2].as_py() * SOURCES
        a1 = min(a0 + SOURCES, len(names))
        absent = sources.column("absent").to_numpy()[order]
        terms = entries.column("term").combine_chunks().dictionary_encode()
        terms = terms.indices if isinstance(terms, pa.DictionaryArray) else pa.array([], pa.int32())
        where = {s: i for i, s in enumerate(names)}
        at = np.array([where[s] for s in entries.column("source").to_pylist()], np.int64)
        sums = pair_sums(terms.to_numpy(zero_copy_only=False).astype(np.int64), at, entries.column("p").to_numpy(), absent, a0, a1)
        a, b = (x.ravel() for x in np.mgrid[a0:a1, 0 : len(names)])
        names = pa.array(names, pa.string())
        keep = a != b
        return pa.table(
            [pa.repeat(key[0], int(keep.sum())), names.take(a[keep]), names.take(b[keep]), sums.ravel()[keep]],
            names=["lang", "source", "item", "value"],
        )

    key = ["lang", "bucket", "block"]
    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        kernel, "lang string, source string, item string, value long"
    )
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: distance of a source's terms from other sources and from its language.

    Terms are runs of letters (bytes from 0x80 on count as letters), A-Z lower-cased.  A language keeps the terms
    that at least ``least_docs`` of its documents hold.  Part ``pair`` compares a source with each other source of the language,
    part ``term`` lists up to ``ranks`` terms that it uses more than its language does.

    Null text, lang and source count as ''.  Each row is a document, repeated rows too.  A group without terms has
    its pairs; in a language that keeps no term their value is 0.  Equal values rank by item, in order of its bytes.
    An empty table gives no rows.  Other columns are not read.
    """
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    docs = docs.select(text, lang, source)
    counts = stored(term_counts(docs))
    words = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    words = words.filter(F.col("docs") >= least_docs).drop("docs")
    kept = stored(counts.drop("docs").join(words, ["lang", "term"]))

    langs = kept.groupBy("lang", "term").agg(F.max("all_n").alias("n"), F.count("*").alias("entries"))
    langs = langs.groupBy("lang").agg(
        F.count("*").alias("terms"), F.sum("n").alias("all_total"), F.sum("entries").alias("entries")
    )
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.na.fill(0, ["terms", "all_total", "entries", "total"]))
    sized = groups.filter("terms > 0").withColumn("absent", _share("0", "(total + terms)"))

    kept = lookup_join(kept, sized.select("lang", "source", "terms", "total", "all_total"), ["lang", "source"], salts=SALTS)
    kept = kept.withColumn("p", _share("n", "(total + terms)"))
    above = kept.withColumn("q", _share("all_n", "(all_total + terms)")).filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value")
    )
    others = groups.filter("terms = 0").select("lang", "source")
    zero = others.join(others.withColumnRenamed("source", "item"), "lang").filter("source <> item")
    pairs = _pairs(kept, sized).unionByName(zero.withColumn("value", F.lit(0).cast("bigint")))
    pairs = pairs.withColumn("part", F.lit("pair"))

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    above = above.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= ranks)
    return above.select(*columns).unionByName(pairs.withColumn("rank", F.row_number().over(best)).select(*columns))
