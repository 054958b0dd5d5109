"""Language of texts and of the spans inside them.

The script of a word narrows the candidate languages; letter trigrams score the word for each; Viterbi
decoding with a penalty for every switch labels the words, so that runs of one language become spans.  The
model is one table of trigram counts per language, summed over all training texts; its size is fixed.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import by_value, texts_of

by_value(__name__)

BUCKETS = 1 << 16
SMOOTHING = 0.3
#: Log-likelihood that a switch of language costs: about two long words of evidence.
SWITCH = 12.0
#: A script is a language's own if at least this share of its letters is written in it.
OWN_SCRIPT = 0.02
UNKNOWN = "und"
CHUNK_CHARS = 1_500_000

# First code points of ranges and the script written in them (fixed values of Unicode blocks).
SCRIPTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0B80, "tamil"),
    (0x0E00, "thai"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x20000, "han"),
    (0x30000, "other"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_STARTS = np.array([a for a, _ in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def _with_a_letter(inside: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """``inside`` without the runs that hold no letter: marks belong to a word but are none by themselves."""
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if not len(edges):
        return inside
    starts, ends = edges[::2], edges[1::2]  # the first and the last character are line ends
    letters = np.concatenate([[0], np.cumsum(letter)])
    for k in np.flatnonzero(letters[ends] == letters[starts]):
        inside[starts[k] : ends[k]] = False
    return inside


class Letters:
    """Letters (and marks on them) of a chunk of texts: trigram buckets, and the words and texts they stand in."""

    def __init__(self, texts: list[str | None]) -> None:
        low = [(t or "").lower() for t in texts]
        codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
        present = np.flatnonzero(np.bincount(codes))
        kinds = np.zeros(int(present[-1]) + 1, np.uint8)
        kinds[present] = [" ML".find(unicodedata.category(chr(c))[0]) + 1 for c in present]
        kinds = kinds[codes]  # 3: letter, 2: mark
        inside = _with_a_letter(kinds > 1, kinds == 3)
        x = np.where(inside, codes, 0).astype(np.uint64)
        at = np.flatnonzero(inside)
        mixed = (
            x[at - 1] * np.uint64(0x9E3779B97F4A7C15)
            + x[at] * np.uint64(0xC2B2AE3D27D4EB4F)
            + x[at + 1] * np.uint64(0x165667B19E3779F9)
        )
        mixed ^= mixed >> np.uint64(29)
        self.buckets = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
        self.starts = np.flatnonzero(~inside[at - 1])  # of words, among the letters
        self.lengths = np.diff(np.append(self.starts, len(at)))
        self.scripts = _SCRIPT_OF[np.searchsorted(_STARTS, codes[at], "right") - 1]
        edges = np.cumsum([0] + [len(t) + 1 for t in low])
        self.letters_to = np.searchsorted(at, edges)  # letters of text d: letters_to[d]:letters_to[d + 1]
        self.words_to = np.searchsorted(at[self.starts], edges)


def _chunks(texts: list[str | None]):
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > CHUNK_CHARS:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: np.ndarray  # bucket x language: log probabilities
    allowed: np.ndarray  # script x language


def train(labelled: DataFrame) -> Model:
    """Counts trigrams and scripts over all rows of (text, lang); rows with a null are left out."""

    def kernel(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lo, hi in _chunks(texts):
                part = Letters(texts[lo:hi])
                names = sorted(set(langs[lo:hi]))
                of_text = np.array([names.index(x) for x in langs[lo:hi]])
                own = np.repeat(of_text, np.diff(part.letters_to))
                width = BUCKETS + len(SCRIPT_NAMES)
                counts = np.bincount(own * width + part.buckets, minlength=len(names) * width)
                counts += np.bincount(own * width + BUCKETS + part.scripts, minlength=len(names) * width)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + counts[k * width : (k + 1) * width]
        for name, counts in sums.items():
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(held)), pa.array(held.astype(np.int32)), pa.array(counts[held])],
                names=["lang", "bucket", "n"],
            )

    rows = labelled.select("text", "lang").filter("text is not null and lang is not null")
    # At most one row for each language and bucket, whatever the size of the corpus.
    table = (
        rows.mapInArrow(kernel, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = table.column("lang").to_pylist()
    langs = tuple(sorted(set(names)))
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    place = {x: k for k, x in enumerate(langs)}
    counts[[place[x] for x in names], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    weights = np.log((grams + SMOOTHING) / (grams.sum(1, keepdims=True) + SMOOTHING * BUCKETS))
    shares = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    return Model(langs, np.ascontiguousarray(weights.T.astype(np.float32)), (shares >= OWN_SCRIPT).T)


def word_scores(weights: np.ndarray, part: Letters) -> np.ndarray:
    """word x language: log probabilities, language by language, so that letters x languages are never held."""
    out = np.empty((len(part.starts), weights.shape[1]), np.float32)
    for k in range(weights.shape[1]):
        out[:, k] = np.add.reduceat(np.ascontiguousarray(weights[:, k])[part.buckets], part.starts)
    return out


def viterbi(scores: np.ndarray, words_to: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word, all texts in step; text d owns words words_to[d]:words_to[d + 1]."""
    n_words, n_langs = scores.shape
    sizes = np.diff(words_to)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = words_to[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than t words
    best_before = np.zeros(n_words, np.int32)
    stays = np.zeros((n_words, n_langs), bool)
    value = np.zeros((len(sizes), n_langs), np.float32)
    for t in range(longest):
        k = active[t]
        at, v = first[:k] + t, value[:k]
        if t:
            top = v.argmax(1)
            jump = v[np.arange(k), top] - switch
            best_before[at] = top
            stays[at] = v >= jump[:, None]
            np.maximum(v, jump[:, None], out=v)
        v += scores[at]
        v -= v.max(1, keepdims=True)
    labels = np.zeros(n_words, np.int32)
    now = value.argmax(1).astype(np.int32)
    for t in range(longest - 1, -1, -1):
        at = first[: active[t]] + t
        label = now[: active[t]]
        labels[at] = label
        if t:
            now[: active[t]] = np.where(stays[at, label], label, best_before[at])
    return labels


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """Per row: doc_id, lang_pred, score, spans (array of start, stop, lang; words of letters are numbered).

    ``lang_pred`` is the language of most letters, ties to the first by name; ``score`` is its share of the
    letters.  ``und`` and 0 without spans if the text is null or has no letter, or the model no language.
    Repeated rows each get their row; an empty table gives none; long texts are decoded whole.
    """
    docs = texts_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.allowed))

    def kernel(batches):
        m = Model(*shared.value)
        n_langs = len(m.langs)
        names = np.array([*m.langs, UNKNOWN], object)
        bar = np.where(m.allowed.any(1, keepdims=True) & ~m.allowed, np.float32(-1e4), np.float32(0))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _chunks(texts):
                part = Letters(texts[lo:hi])
                n = hi - lo
                pred, score = np.full(n, n_langs), np.zeros(n)
                spans = pa.array([[]] * n, _SPANS)
                if n_langs and len(part.starts):
                    scores = word_scores(m.weights, part)
                    scores += bar[part.scripts[part.starts]]
                    labels = viterbi(scores, part.words_to, switch)
                    of_text = np.repeat(np.arange(n), np.diff(part.words_to))
                    letters = np.bincount(
                        of_text * n_langs + labels, part.lengths, minlength=n * n_langs
                    ).reshape(n, n_langs)
                    total = letters.sum(1)
                    some = total > 0
                    pred[some] = letters[some].argmax(1)
                    score[some] = letters[some].max(1) / total[some]
                    new = np.ones(len(labels), bool)
                    new[1:] = (labels[1:] != labels[:-1]) | (of_text[1:] != of_text[:-1])
                    at = np.flatnonzero(new)
                    ends = np.append(at[1:], len(labels))
                    origin = part.words_to[of_text[at]]
                    spans = pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(of_text[at], np.arange(n + 1)).astype(np.int32)),
                        pa.StructArray.from_arrays(
                            [pa.array((at - origin).astype(np.int32)), pa.array((ends - origin).astype(np.int32)),
                             pa.array(names[labels[at]], pa.string())],
                            names=["start", "stop", "lang"],
                        ),
                    )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, n), pa.array(names[pred], pa.string()), pa.array(score), spans],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        kernel,
        f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string>>",
    )


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))


def held_out(id_col: str = "doc_id", folds: int = 5):
    return F.crc32(F.col(id_col).cast("string")) % folds == 0


def identify_languages(docs: DataFrame) -> DataFrame:
    """Trains on the texts with a language outside the held-out fold and labels every row of ``docs``.

    Adds held_out (crc32 of the id as text divisible by 5; null id: false, but such rows are not trained on).
    """
    training = docs.select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out().alias("h")
    ).filter("not h")
    found = identify(docs, train(training))
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans"
    )
