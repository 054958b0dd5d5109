"""Substring deduplication by recompression.

Words get global names (64-bit hashes).  Rounds of renaming follow: a run of one symbol becomes a symbol, then
every pair of a "left" and a "right" symbol becomes one; the side follows from the name alone.  Whether two
neighbours merge depends on nothing but them, so equal substrings end up with equal symbols but for a few
words at either end.  Symbols never grow beyond ``LONGEST`` words, which bounds those few words:

    a run at the end (LONGEST) and one symbol (LONGEST - 1) for each of ROUNDS pair rounds,

so the whole symbols further inside a window are those of all its copies.  A phrase is ``PHRASE`` symbols in a
row; each window is known by the phrase of smallest name that begins in a fixed range inside it.  These phrases
are counted over all documents in Spark.  A window can only repeat if its phrase stands in two different
documents; all such windows are compared as wholes (96-bit hashes).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import Words, as_bytes, by_value, chunks, mix, packed, span_hashes, stored, texts_of, unpacked

by_value(__name__)

WINDOW = 50
LONGEST, ROUNDS, PHRASE = 3, 2, 4


#: Words at either end of a window whose symbols may differ between its copies.
EDGE = LONGEST + ROUNDS * (LONGEST - 1)


def starts_inside(window: int) -> int:
    """From how many places on, behind the edge, a phrase may begin and lie inside all the same."""
    return window - 2 * EDGE - PHRASE * LONGEST + 1


def symbols(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, words) of the highest symbols over ``names``; they never cross texts."""
    first = np.arange(len(names))
    # Runs of up to LONGEST equal words become one symbol; longer ones stay as they are.
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(names)))
    short = size <= LONGEST
    keep = np.repeat(~short, size)
    keep[begin] = True
    length = np.ones(len(names), np.int64)
    length[begin[short]] = size[short]
    run = length > 1
    names = np.where(run, mix(names * np.uint64(31) + length.astype(np.uint64)), names)
    names, first, length = names[keep], first[keep], length[keep]
    text = text[first]
    for r in range(ROUNDS):
        left = (mix(names + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(names), bool)
        joins[:-1] = left[:-1] & ~left[1:] & (length[:-1] + length[1:] <= LONGEST) & (text[:-1] == text[1:])
        at = np.flatnonzero(joins)
        names = names.copy()
        names[at] = mix(names[at] * np.uint64(0x9E3779B97F4A7C15) + names[at + 1] + np.uint64(r))
        length = length.copy()
        length[at] += length[at + 1]
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names, first, length, text = names[keep], first[keep], length[keep], text[keep]
    return names, first, length


def window_phrases(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every window of the chunk: the smallest phrase that begins in its range."""
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    n = len(w.hashes)
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    names, first, _ = symbols(w.hashes, text)
    m = len(names) - PHRASE + 1
    name = np.zeros(m, np.uint64)
    for j in range(PHRASE):
        name = name * np.uint64(0xC2B2AE3D27D4EB4F) + names[j : j + m]
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)  # by the word where a phrase begins
    least[first[:m]] = mix(name)
    # Least of each ``width`` neighbours, by doubling.
    width, held = starts_inside(window), 1
    while held * 2 <= width:
        least, held = np.minimum(least[:-held], least[held:]), held * 2
    if width > held:
        least = np.minimum(least[: len(least) - (width - held)], least[width - held :])
    at = np.arange(n - window + 1)
    at = at[text[at] == text[at + window - 1]]
    return at, least[at + EDGE]


def _check(window: int) -> None:
    if starts_inside(window) < LONGEST:
        raise ValueError(f"a window of {window} words is too short for phrases of {PHRASE} symbols")


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_words, words_key, whole_sha256) of every row."""

    def kernel(batches):
        for batch in batches:
            counts, keys, shas = [], [], []
            for t in as_bytes(batch.column("text")):
                words = _split(t)
                joined = b" ".join(words)
                counts.append(len(words))
                keys.append(hashlib.blake2b(joined, digest_size=16).digest())
                shas.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(shas)],
                names=["doc_id", "row", "n_words", "words_key", "whole_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(kernel, f"doc_id {kind}, row long, n_words long, words_key binary, whole_sha256 string")


def _sequence_keys(w: Words) -> np.ndarray:
    """64 bits of each text's words: a sum in which every word is mixed with its place, so that no order is alike."""
    sizes = np.diff(w.first)
    place = np.arange(len(w.hashes), dtype=np.uint64) - np.repeat(w.first[:-1], sizes).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hashes + mix(place + np.uint64(1))))])
    return mix(sums[w.first[1:]] - sums[w.first[:-1]] + sizes.astype(np.uint64))


def _phrases(docs: DataFrame, window: int) -> DataFrame:
    """(phrase, doc_id, row, words_key): the phrases of a row's windows, each once; the key is 64 bits of the words'."""

    def kernel(batches):
        for batch in batches:
            texts, ids, rows = as_bytes(batch.column("text")), batch.column("doc_id"), batch.column("row")
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi])
                at, name = window_phrases(w, window)
                new = np.ones(len(at), bool)  # a phrase serves many windows in a row
                new[1:] = (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1)
                at, name = at[new], name[new]
                of = np.searchsorted(w.first, at, "right") - 1
                keys, own = _sequence_keys(w)[of], pa.array(of + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), ids.take(own), rows.take(own), pa.array(keys.view(np.int64))],
                    names=["phrase", "doc_id", "row", "words_key"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(kernel, f"phrase long, doc_id {kind}, row long, words_key long")


# bytes.split() splits at the six white-space characters, and at 0x1C-0x1F not: exactly the words asked for.
def _split(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def _windows(shared: DataFrame, window: int) -> DataFrame:
    """(h1, h2, doc_id, row, at) of every window whose phrase is among the row's ``phrases``."""

    def kernel(batches):
        for batch in batches:
            texts = unpacked(batch)
            ids, rows, lists = batch.column("doc_id"), batch.column("row"), batch.column("phrases").to_pylist()
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi])
                at, name = window_phrases(w, window)
                cut = np.searchsorted(at, w.first)
                hit = np.zeros(len(at), bool)
                for d in range(hi - lo):
                    own = slice(cut[d], cut[d + 1])
                    hit[own] = np.isin(name[own], np.array(lists[lo + d], np.int64).view(np.uint64))
                at = at[hit]
                h1 = span_hashes(w.hashes, at, at + window)
                h2 = span_hashes(mix(w.hashes + np.uint64(0x5851F42D4C957F2D)), at, at + window)
                of = np.searchsorted(w.first, at, "right") - 1
                own = pa.array(of + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32)),
                     ids.take(own), rows.take(own), pa.array((at - w.first[of]).astype(np.int32))],
                    names=["h1", "h2", "doc_id", "row", "at"],
                )

    kind = shared.schema["doc_id"].dataType.simpleString()
    return shared.mapInArrow(kernel, f"h1 long, h2 int, doc_id {kind}, row long, at int")


def _removed(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, n_words, n_removed, kept_sha256, kept_text) of rows with text and the starts of copied windows."""

    def kernel(batches):
        for batch in batches:
            counts, gone, shas, kept = [], [], [], []
            for text, starts in zip(unpacked(batch), batch.column("starts").to_pylist()):
                words = _split(text)
                keep = np.zeros(len(words) + 1, np.int64)
                at = np.array(sorted(set(starts)), np.int64)
                keep[at] += 1
                np.add.at(keep, at + window, -1)
                stays = np.cumsum(keep[:-1]) == 0
                left = b" ".join([w for w, s in zip(words, stays.tolist()) if s])
                counts.append(len(words))
                gone.append(len(words) - int(stays.sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(shas), pa.array(kept, pa.string())],
                names=["doc_id", "row", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        kernel, f"doc_id {kind}, row long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )


_EMPTY = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and kept_text where something but not all is removed.

    A word is removed if some window of ``window`` words that covers it also starts in a document with a smaller
    doc_id.  Windows are judged on the input.  ``kept_sha256`` hashes the kept words joined by one space.

    Null and empty texts have no words.  A row without id is no one's earlier document and loses nothing.
    Rows that repeat a doc_id are judged one by one, and never against each other.  An empty table gives none.
    """
    _check(window)
    # A row is known by its id and its text: rows that agree in both have the same result.
    docs = texts_of(docs).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    one = ["doc_id", "row"]
    base = stored(_measured(docs))
    # A document with the words of an earlier one is gone as a whole; the earliest stands for all.
    whole = F.when(F.col("n_words") >= window, F.col("words_key"))
    firsts = base.filter("doc_id is not null").groupBy("words_key").agg(F.min("doc_id").alias("first_id"))
    judged = base.withColumn("words_key", whole).join(firsts, "words_key", "left")
    copies = judged.filter("doc_id > first_id").select(*one, "n_words")
    alone = stored(judged.filter("not coalesce(doc_id > first_id, false)").select(*one, "n_words", "whole_sha256"))

    found = _phrases(docs.filter("doc_id is not null"), window)
    shared = (
        found.groupBy("phrase")
        .agg(F.min("words_key").alias("lo"), F.max("words_key").alias("hi"))
        .filter("lo <> hi")
        .select("phrase")
    )
    wanted = found.select("phrase", *one).join(shared, "phrase").groupBy(*one).agg(
        F.collect_set("phrase").alias("phrases")
    )
    wanted = wanted.join(copies.select(*one).distinct(), one, "left_anti")
    open_docs = stored(packed(docs).join(wanted, one))
    windows = _windows(open_docs, window)
    # Stored, so that both sides of the join are plain shuffles and a hot window's rows can be split.
    earliest = stored(
        windows.groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        .filter("lo < hi")
        .select("h1", "h2", "lo")
    )
    repeated = windows.join(earliest, ["h1", "h2"]).filter("doc_id > lo")
    starts = repeated.groupBy(*one).agg(F.collect_set("at").alias("starts"))
    cut = stored(_removed(open_docs.select(*one, "packed").join(starts, one), window))

    untouched = alone.join(cut.select(*one).distinct(), one, "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept_text"),
    )
    emptied = copies.select(
        "doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(_EMPTY).alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept_text"),
    )
    partly = cut.join(alone.select(*one).distinct(), one, "left_semi")
    return untouched.unionByName(emptied).unionByName(partly.select(*untouched.columns))
