"""Benchmark decontamination: Wu-Manber search for windows of benchmark words.

Patterns are windows of consecutive benchmark words.  A *block* is two words.  The shift table says how
far the end of a window may move when a block ends there (a block of no pattern: nearly a whole window), so
most words are never looked at.  A block that ends a pattern has shift 0: its bucket lists the patterns
that end so, and each is compared word by word.  Patterns of equal length share one pair of tables.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import as_bytes, by_value, stored, texts_of

by_value(__name__)

WINDOW = 10
#: Bytes of benchmark text whose tables a task holds at once; more items are searched in several blocks.
BLOCK_BYTES = 4 << 20

# Lower-cases A-Z; every other ASCII byte but 0-9 and a-z is a gap between words.
_NORMAL = bytes(
    b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


class Patterns:
    """Shift tables and buckets of all windows of some items."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        self.names = [name for name, _ in items]
        self.items = [words(text) for _, text in items]
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, w in enumerate(self.items):
            m = min(window, len(w))
            if m:
                ends[m] += [(k, at) for at in range(len(w) - m + 1)]
        self.tables = [(m, *self._tables(m, ends[m])) for m in sorted(ends)]

    def _tables(self, m: int, patterns: list[tuple[int, int]]):
        size = min(2, m)
        shifts: dict[tuple, int] = {}
        buckets: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, at in patterns:
            w = self.items[k]
            for j in range(size, m + 1):
                block = tuple(w[at + j - size : at + j])
                shifts[block] = min(shifts.get(block, m), m - j)
            buckets[tuple(w[at + m - size : at + m])].append((k, at))
        return size, shifts, dict(buckets)

    def search(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs of hit words as (from, to), and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for m, size, shifts, buckets in self.tables:
            longest, end, n = m - size + 1, m, len(text)
            while end <= n:
                block = (text[end - 2], text[end - 1]) if size == 2 else (text[end - 1],)
                shift = shifts.get(block, longest)
                if shift:
                    end += shift
                    continue
                window = text[end - m : end]
                hits = [k for k, at in buckets[block] if self.items[k][at : at + m] == window]
                if hits:
                    found.update(hits)
                    spans.append((end - m, end))
                end += 1
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_KINDS = "doc_id {}, text_key binary, n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def _scan(docs: DataFrame, items: list[tuple[str | None, bytes | None]], window: int) -> DataFrame:
    patterns = docs.sparkSession.sparkContext.broadcast((items, window))

    def kernel(batches):
        tables = Patterns(*patterns.value)
        for batch in batches:
            keys, counts, spans, found = [], [], [], []
            for text in as_bytes(batch.column("text")):
                w = words(text)
                runs, hits = tables.search(w)
                keys.append(hashlib.blake2b(text or b"", digest_size=16).digest())
                counts.append(len(w))
                spans.append([{"a": a, "b": b} for a, b in runs])
                found.append(sorted({tables.names[k] for k in hits if tables.names[k] is not None}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(keys, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    pa.array(found, pa.list_(pa.string())),
                ],
                names=["doc_id", "text_key", "n_words", "spans", "items"],
            )

    return docs.mapInArrow(kernel, _KINDS.format(docs.schema["doc_id"].dataType.simpleString()))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of about ``block_bytes`` of text: what the driver and a task hold at once."""
    bench = benchmark.select(
        F.col("item_id").cast("string").alias("name"), F.col("text").cast("string").cast("binary").alias("t")
    ).filter("t is not null")
    size = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("name", "t"), F.lit(blocks))
    for b in range(blocks):
        yield [(r.name, bytes(r.t)) for r in bench.filter(block == b).collect()]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    A window is ``window`` consecutive words of an item (a shorter item is one window); a word inside any
    occurrence of a window is hit.  ``spans`` are the runs of hit words, ``items`` the item ids as strings.

    Null and empty texts have no words.  Repeated rows each get their row.  Items that are null, empty or
    repeated are harmless; the windows of an item without id hit words but are not listed.  An empty
    benchmark hits nothing.  The benchmark is the query set: it is sent to the tasks in blocks of about
    ``block_bytes`` of text, one pass over ``docs`` for each block.
    """
    docs = texts_of(docs)
    scans = [_scan(docs, items, window) for items in _blocks(benchmark, block_bytes)]
    rows = scans[0] if len(scans) == 1 else _joined([stored(s) for s in scans])
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
        "items",
    )


def _united(rows: DataFrame) -> DataFrame:
    """Spans that several blocks found in one text, merged to runs."""

    def kernel(batches):
        for batch in batches:
            runs = [
                [{"a": a, "b": b} for a, b in merged([(s["a"], s["b"]) for s in spans])]
                for spans in batch.column("spans").to_pylist()
            ]
            at = batch.schema.get_field_index("spans")
            yield batch.set_column(at, "spans", pa.array(runs, batch.schema.field(at).type))

    return rows.mapInArrow(kernel, rows.schema)


def _joined(scans: list[DataFrame]) -> DataFrame:
    """One row for each row of the first scan, with what all scans found in its text."""
    every = scans[0]
    for s in scans[1:]:
        every = every.unionByName(s)
    found = (
        every.filter(F.size("spans") > 0)
        .groupBy("doc_id", "text_key")
        .agg(
            F.flatten(F.collect_set("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    base = scans[0].select("doc_id", "text_key", "n_words").alias("x")
    found = _united(found.select("doc_id", "text_key", "spans", "items")).alias("y")
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.text_key") == F.col("y.text_key"))
    return base.join(found, same, "left").select(
        "x.doc_id",
        "x.n_words",
        F.coalesce("y.spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"),
        F.coalesce("y.items", F.array().cast("array<string>")).alias("items"),
    )


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window of the benchmark; cases as above."""
    for items in _blocks(benchmark, block_bytes):
        patterns = docs.sparkSession.sparkContext.broadcast((items, window))

        def kernel(batches, patterns=patterns):
            tables = Patterns(*patterns.value)
            for batch in batches:
                texts = as_bytes(batch.column(batch.schema.get_field_index("text")))
                yield batch.filter(pa.array([not tables.search(words(t))[0] for t in texts], pa.bool_()))

        docs = docs.mapInArrow(kernel, docs.schema)
    return docs
