"""Suffix-array deduplication of bytes by a common-prefix-aware distributed merge sort.

Sorting every suffix is more than the question needs: a string of ``WINDOW`` bytes can only repeat if the
``MER`` bytes of smallest hash inside it repeat.  So the suffixes that start at such anchors are sorted, and of
these only those whose anchor occurs twice in the corpus.  A suffix is cut after ``WINDOW`` bytes and followed by
the bytes before the anchor, read backwards: entries of one anchor come together, and those with the same
surroundings are neighbours that are wholly equal.

Each task sorts its entries into runs and writes them front-coded (length of the prefix shared with the entry
before, then the rest).  Runs are exchanged by anchor, and a loser tree merges them: a node keeps the loser's
common prefix with the last winner, so two entries are compared only beyond what is known to be equal.  The
merged order yields, anchor by anchor, the distinct surroundings, and these decide every window around the
anchor.  Anchors with very many occurrences are decided window by window in Spark instead of in one task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import as_bytes, by_value, chunks, mix, partitions, powers, stored, texts_of

by_value(__name__)

WINDOW, MER = 200, 64
BEFORE = WINDOW - MER
SIZE = WINDOW + BEFORE
#: Fills entries beyond the ends of a text; no byte of UTF-8.
PAD = b"\xff"
#: Entries of a run, and about as many that a merging task gets.
RUN = 40_000
#: An anchor with more occurrences is decided by joins instead of in one task.
CROWDED = 20_000
#: Entries whose windows are hashed at once, and hashes that are sorted at once.
BLOCK = 1_024
CELLS = 1 << 18


def mer_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on."""
    n = len(data)
    ups, downs = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ups[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * downs[: n - size + 1])


def _slid(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, by doubling."""
    held = 1
    while held * 2 <= width:
        values = pick(values[:-held], values[held:])
        held *= 2
    rest = width - held
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """(name, place, text, all bytes, where each text starts) of the anchors of a chunk of texts."""
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    data = b"".join(t or b"" for t in texts)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    none = np.empty(0, np.int64)
    if len(data) < WINDOW:
        return none.astype(np.uint64), none, none, data, starts
    names = mer_hashes(np.frombuffer(data, np.uint8), MER)
    least = _slid(names, BEFORE + 1, np.minimum)  # of each window
    ends = np.repeat(starts[1:], sizes)[: len(least)]
    least = np.where(np.arange(len(least)) + WINDOW <= ends, least, np.uint64(0))
    edge = np.zeros(BEFORE, np.uint64)
    most = _slid(np.concatenate([edge, least, edge]), BEFORE + 1, np.maximum)  # of the windows around a place
    at = np.flatnonzero((names == most) & (most > 0))
    return names[at], at, np.searchsorted(starts, at, "right") - 1, data, starts


def entry(data: bytes, at: int, low: int, high: int) -> bytes:
    """The sorted form of the anchor at ``at`` in the text data[low:high]."""
    right = data[at : min(at + WINDOW, high)]
    left = data[max(low, at - BEFORE) : at][::-1]
    return right + PAD * (WINDOW - len(right)) + left + PAD * (BEFORE - len(left))


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two entries that agree in ``known`` bytes."""
    if a == b:
        return SIZE
    n = SIZE - known
    differ = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return known + n - (differ.bit_length() + 7) // 8


def front_coded(entries: list[tuple[bytes, int]]) -> bytes:
    """A sorted run of (entry, copies): prefix lengths, copies, and what is new in each entry."""
    shared, rest, last = [], [], b""
    for text, _ in entries:
        k = common_prefix(last, text, 0) if last else 0
        shared.append(k)
        rest.append(text[k:])
        last = text
    n = len(entries)
    return struct.pack(f"<I{n}H{n}I", n, *shared, *(c for _, c in entries)) + b"".join(rest)


def decoded(run: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(entry, prefix shared with the one before, copies) of a run."""
    (n,) = struct.unpack_from("<I", run)
    shared = struct.unpack_from(f"<{n}H", run, 4)
    copies = struct.unpack_from(f"<{n}I", run, 4 + 2 * n)
    at, last = 4 + 6 * n, b""
    for k, c in zip(shared, copies):
        end = at + SIZE - k
        last = last[:k] + run[at:end]
        at = end
        yield last, k, c


def merge(runs: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(entry, prefix shared with the one before, copies) of all runs in order, by a loser tree.

    ``known[r]`` is what the head of run r shares with the entry written last; only heads that share equally
    much with it are compared, and from there on.  The loser keeps what it shares with the winner.
    """
    count = len(runs)
    heads: list[tuple[bytes, int, int] | None] = [next(r, None) for r in runs]
    known = [0] * count
    losers = [-1] * count

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes first; sets the loser's ``known``."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return y is None
        if known[a] != known[b]:
            return known[a] > known[b]
        k = common_prefix(x[0], y[0], known[a])
        first = k == SIZE or x[0][k] < y[0][k]
        known[b if first else a] = k
        return first

    def play(node: int) -> int:
        if node >= count:
            return node - count
        a, b = play(2 * node), play(2 * node + 1)
        first = beats(a, b)
        losers[node] = b if first else a
        return a if first else b

    winner = play(1) if count > 1 else 0
    while heads[winner] is not None:
        text, _, copies = heads[winner]
        yield text, known[winner], copies
        heads[winner] = next(runs[winner], None)
        if heads[winner] is not None:
            known[winner] = heads[winner][1]
        node = (winner + count) // 2
        while node:
            other = losers[node]
            if not beats(winner, other):
                losers[node], winner = winner, other
            node //= 2


def _context(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _window_hashes(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window around the anchor of some entries, and whether it lies inside its text."""
    n = len(entries)
    table = np.frombuffer(b"".join(entries), np.uint8).reshape(n, SIZE)
    order = np.concatenate([np.arange(SIZE - 1, WINDOW - 1, -1), np.arange(WINDOW)])  # as in the text
    table = table[:, order]
    pads = np.zeros((n, SIZE + 1), np.int32)
    np.cumsum(table == 255, axis=1, out=pads[:, 1:])
    ups, downs = powers(SIZE + 1)
    sums = np.zeros((n, SIZE + 1), np.uint64)
    np.cumsum((table.astype(np.uint64) + np.uint64(1)) * ups[:SIZE], axis=1, out=sums[:, 1:])
    valid = pads[:, WINDOW:] == pads[:, : BEFORE + 1]
    return mix((sums[:, WINDOW:] - sums[:, : BEFORE + 1]) * downs[: BEFORE + 1]), valid


def decide(entries: list[bytes], copies: list[int]) -> list[tuple[bytes, int, int]]:
    """(context, from, to) around an anchor that repeated windows cover, for its distinct entries."""
    n = len(entries)
    if n == 1:
        if copies[0] < 2:
            return []
        left, right = BEFORE - entries[0].count(PAD, WINDOW), WINDOW - entries[0].count(PAD, 0, WINDOW)
        if left + right < WINDOW:
            return []
        return [(_context(entries[0]), -left, right)]
    hashes = np.empty((n, BEFORE + 1), np.uint64)
    valid = np.empty((n, BEFORE + 1), bool)
    for lo in range(0, n, BLOCK):
        hashes[lo : lo + BLOCK], valid[lo : lo + BLOCK] = _window_hashes(entries[lo : lo + BLOCK])
    repeated = np.zeros((n, BEFORE + 1), bool)
    width = max(1, CELLS // n)
    for k in range(0, BEFORE + 1, width):
        own, some = hashes[:, k : k + width], valid[:, k : k + width]
        order = np.argsort(own, axis=0, kind="stable")
        ranked, inside = np.take_along_axis(own, order, 0), np.take_along_axis(some, order, 0)
        same = (ranked[1:] == ranked[:-1]) & inside[1:] & inside[:-1]
        twice = np.zeros(order.shape, bool)
        twice[1:] = same
        twice[:-1] |= same
        np.put_along_axis(repeated[:, k : k + width], order, twice, 0)
    repeated |= (np.array(copies) > 1)[:, None]
    repeated &= valid
    out = []
    for k in np.flatnonzero(repeated.any(1)):
        at = np.flatnonzero(repeated[k])
        out.append((_context(entries[k]), int(at[0]) - BEFORE, int(at[-1]) - BEFORE + WINDOW))
    return out


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, sha, names) of every row."""

    def kernel(batches):
        for batch in batches:
            texts, ids = as_bytes(batch.column("text")), batch.column("doc_id")
            for lo, hi in chunks(texts):
                name, _, of, _, _ = anchors(texts[lo:hi])
                cut = np.searchsorted(of, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array([len(t or b"") for t in texts[lo:hi]], pa.int64()),
                        pa.array([hashlib.sha256(t or b"").hexdigest() for t in texts[lo:hi]]),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(name.view(np.int64))),
                    ],
                    names=["doc_id", "n_bytes", "sha", "names"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(kernel, f"doc_id {kind}, n_bytes long, sha string, names array<bigint>")


def _hits(batch: pa.RecordBatch, lists: str):
    """Anchors of a batch whose name is in the row's list: (row, name, place, data, low, high)."""
    texts, wanted = as_bytes(batch.column("text")), batch.column(lists).to_pylist()
    for lo, hi in chunks(texts):
        name, at, of, data, starts = anchors(texts[lo:hi])
        sets = [set(x or ()) for x in wanted[lo:hi]]
        for n, p, d in zip(name.view(np.int64).tolist(), at.tolist(), of.tolist()):
            if n in sets[d]:
                yield lo + d, n, p, data, int(starts[d]), int(starts[d + 1])


def _sorted_runs(open_texts: DataFrame, parts: int) -> DataFrame:
    """Rows (part, n, run) of front-coded runs, and rows (context, sha, at) of the anchors in them."""

    def flushed(held: dict[int, dict[bytes, int]]):
        rows = [(p, len(e), front_coded(sorted(e.items()))) for p, e in held.items()]
        held.clear()
        for p, n, run in rows:
            yield pa.RecordBatch.from_pylist([{"part": p, "n": n, "run": run, "context": None, "sha": None, "at": None}], _RUNS)

    def kernel(batches):
        held: dict[int, dict[bytes, int]] = {}
        size = 0
        for batch in batches:
            shas = batch.column("sha").to_pylist()
            contexts, of, places = [], [], []
            for row, name, at, data, low, high in _hits(batch, "names"):
                text = entry(data, at, low, high)
                own = held.setdefault(name % parts, {})
                size += text not in own
                own[text] = own.get(text, 0) + 1
                contexts.append(_context(text))
                of.append(shas[row])
                places.append(at - low)
                if size >= RUN:
                    yield from flushed(held)
                    size = 0
            n = len(contexts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(contexts, pa.binary()),
                 pa.array(of, pa.string()), pa.array(places, pa.int64())],
                schema=_RUNS,
            )
        yield from flushed(held)

    return open_texts.mapInArrow(kernel, "part int, n long, run binary, context binary, sha string, at long")


_RUNS = pa.schema(
    [("part", pa.int32()), ("n", pa.int64()), ("run", pa.binary()), ("context", pa.binary()), ("sha", pa.string()),
     ("at", pa.int64())]
)


def _merged(runs: DataFrame) -> DataFrame:
    """(context, lo, hi) from all runs of a part."""

    def kernel(table: pa.Table) -> pa.Table:
        merged = merge([decoded(r) for r in table.column("run").to_pylist()])
        out: list[tuple[bytes, int, int]] = []
        entries: list[bytes] = []
        copies: list[int] = []
        for text, shared, n in merged:
            if shared == SIZE and entries:
                copies[-1] += n
                continue
            if shared < MER and entries:
                out += decide(entries, copies)
                entries, copies = [], []
            entries.append(text)
            copies.append(n)
        if entries:
            out += decide(entries, copies)
        c, lo, hi = zip(*out) if out else ((), (), ())
        return pa.table(
            {"context": pa.array(c, pa.binary()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())}
        )

    return runs.groupBy("part").applyInArrow(kernel, "context binary, lo long, hi long")


def _columns(keys: list[bytes], of: list[str], places: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(of, pa.string()), pa.array(places, pa.int64())],
        names=["window_key", "sha", "lo"],
    )


def _crowded_windows(open_texts: DataFrame) -> DataFrame:
    """(window_key, sha, lo) of every window around the anchors in ``crowded``."""

    def kernel(batches):
        for batch in batches:
            shas = batch.column("sha").to_pylist()
            keys, of, places = [], [], []
            for row, _, at, data, low, high in _hits(batch, "crowded"):
                for s in range(max(low, at - BEFORE), min(at, high - WINDOW) + 1):
                    keys.append(_context(data[s : s + WINDOW]))
                    of.append(shas[row])
                    places.append(s - low)
                if len(keys) > RUN:
                    yield _columns(keys, of, places)
                    keys, of, places = [], [], []
            yield _columns(keys, of, places)

    return open_texts.mapInArrow(kernel, "window_key binary, sha string, lo long")


def _cut(rows: DataFrame) -> DataFrame:
    """(sha, n_removed, n_spans, kept_sha256, kept) of texts and the ranges to remove."""

    def kernel(batches):
        for batch in batches:
            out = []
            for sha, text, ranges in zip(
                batch.column("sha").to_pylist(), as_bytes(batch.column("text")), batch.column("ranges").to_pylist()
            ):
                spans: list[list[int]] = []
                for a, b in sorted((r["lo"], r["hi"]) for r in ranges):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((sha, len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, _CUT.types)], schema=_CUT
            )

    return rows.mapInArrow(kernel, "sha string, n_removed long, n_spans long, kept_sha256 string, kept binary")


_CUT = pa.schema(
    [("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
     ("kept", pa.binary())]
)
_EMPTY = hashlib.sha256(b"").hexdigest()


def remove_repeated_bytes(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept where some bytes are removed but not all.

    A byte of the UTF-8 text is removed if some 200-byte string that covers it also starts anywhere else, in the
    same row or another.  Strings are judged on the input; ``n_spans`` counts maximal removed runs.

    Null and empty texts have no bytes.  Rows with equal texts (also repeated rows, and rows without id) are copies
    of each other: from 200 bytes on they lose everything.  An empty table gives none.  An anchor with more than
    ``crowded`` occurrences is decided by joins; the result is the same.
    """
    docs = texts_of(docs)
    base = stored(_named(docs))
    classes = stored(
        base.groupBy("sha").agg(
            F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("rep"), F.first("names").alias("names")
        )
    )
    # Equal texts are one class and read once; of its anchors those count that occur twice in all classes.
    named = classes.select("sha", "rep", F.explode("names").alias("name"))
    shared = stored(named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    parts = max(partitions(docs.sparkSession), int(total) // RUN + 1)
    few, many = F.col("n") <= crowded, F.col("n") > crowded
    wanted = (
        named.join(shared, "name")
        .groupBy("sha", "rep")
        .agg(F.collect_set(F.when(few, F.col("name"))).alias("names"), F.collect_set(F.when(many, F.col("name"))).alias("crowded"))
    )
    keyed = docs.filter("text is not null").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.rep")) & (F.col("d.sha") == F.col("w.sha"))
    open_texts = stored(
        keyed.join(wanted.alias("w"), same).select("w.sha", "d.text", "w.names", "w.crowded").dropDuplicates(["sha"])
    )
    table = stored(_sorted_runs(open_texts, parts))
    found = _merged(table.filter("part is not null").select("part", "run"))
    ranges = table.filter("part is null").join(found, "context").select(
        "sha", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")
    )
    windows = stored(_crowded_windows(open_texts.filter(F.size("crowded") > 0)).distinct())
    twice = windows.groupBy("window_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranges = ranges.union(
        windows.join(twice, "window_key").select("sha", "lo", (F.col("lo") + WINDOW).alias("hi"))
    )
    per_text = ranges.groupBy("sha").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    cut = _cut(open_texts.select("sha", "text").join(per_text, "sha"))

    copied = (F.col("rows") > 1) & (F.col("n_bytes") >= WINDOW)
    joined = base.drop("names").join(classes.select("sha", "rows"), "sha").join(cut, "sha", "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copied, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(~copied, F.col("kept")).alias("kept"),
    )
