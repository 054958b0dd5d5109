"""Quality classifier by co-training: one classifier sees the text, the other the page's metadata.

Both are logistic regressions fitted by Newton steps whose sums Spark computes over all rows.  After a first fit
on labelled rows they exchange pseudo-labels for some rounds: where one view is confident about an unlabelled
document, the other view learns from it.  Each view is then calibrated on labelled rows that neither has
seen, and the calibrated views are combined into one probability for every document.

A document is wanted if it is labelled of good quality and not toxic.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import by_value, stored

by_value(__name__)

#: Labelled rows that words are learnt from and classifiers are fitted on, at most (those of smallest hash).
LABELLED_ROWS = 20_000
#: Words kept as signs of unwanted text, at most, and what they need.
SIGNS, SIGN_DOCUMENTS, SIGN_SCORE, SIGN_ODDS = 1_000, 5, 4.0, 1.2
#: Letters of a beginning of a longer word, which may be a sign too.
BEGINNING = 5
#: Words of a block within which distinct words are counted, so that their share doesn't fall with length.
SPAN = 200
ROUNDS, CONFIDENT, PSEUDO_WEIGHT = 2, 0.98, 0.2
RIDGE = 1e-3

_LETTERS = re.compile(r"[^\W\d_]+")
_BLOCK, _LANGS, _SOURCES = 3, 8, 16
TEXT_SIZE = 17
META_SIZE = 4 + _LANGS + _SOURCES


def text_features(text: str | None, signs: frozenset[str]) -> list[float]:
    """What the text itself shows; the first is the constant.  Signs are words, or "^" and a beginning."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0, 0.0, 1.0] + [0.0] * (TEXT_SIZE - 3)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = sum(map(text.count, "#*$%&|<>"))
    upper = sum(map(str.isupper, words))
    threes = list(zip(words, words[1:], words[2:]))
    repeated = 1 - len(set(threes)) / len(threes) if threes else 0.0
    plain = set(_LETTERS.findall(text.lower())) if signs else set()
    hits = len(signs & plain)
    begun = sum(("^" + w[:BEGINNING]) in signs for w in plain)
    closed = sum(x.rstrip()[-1] in ".!?:;…。！？\"'”’»)" for x in lines)
    return [
        1.0,
        float(np.log1p(n)) / 5,
        float(n < 50),
        min(symbols / n, 2.0),
        min(text.count("!!") / n, 1.0),
        upper / n,
        repeated,
        1 - len(set(lines)) / len(lines),
        1 - sum(len(set(words[i : i + SPAN])) for i in range(0, n, SPAN)) / n,
        min(hits, 3) * 1.0,
        float(bool(hits)),
        closed / len(lines),
        min(sum(map(str.isdigit, text)) / len(text), 1.0),
        min(len(text) / n / 10, 3.0),
        float(np.log1p(begun)),
        min(30 * begun / n, 3.0),
        min(begun, 3) * 1.0,
    ]


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What the page's record shows; names fall into a fixed number of hashed places."""
    out = [0.0] * META_SIZE
    size = float(np.log1p(max(n_chars or 0, 0))) / 5
    out[:4] = [1.0, size, size * size, float(n_chars is None)]
    out[4 + zlib.crc32((lang or "").encode()) % _LANGS] = 1.0
    out[4 + _LANGS + zlib.crc32((source or "").encode()) % _SOURCES] = 1.0
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Model:
    signs: frozenset[str]
    text: tuple[float, ...]
    meta: tuple[float, ...]
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    combined: tuple[float, float, float]


def _record(batch: pa.RecordBatch, name: str) -> list:
    at = batch.schema.get_field_index(name)
    return batch.column(at).to_pylist() if at >= 0 else [None] * batch.num_rows


def _both_views(batch: pa.RecordBatch, names: tuple[str, str, str, str], signs: frozenset[str]):
    text, lang, source, n_chars = names
    x = np.array([text_features(t, signs) for t in _record(batch, text)]).reshape(-1, TEXT_SIZE)
    m = np.array(
        [meta_features(*row) for row in zip(_record(batch, lang), _record(batch, source), _record(batch, n_chars))]
    ).reshape(-1, META_SIZE)
    return x, m


_NAMES = ("text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """The columns that count, with their expected types; a missing one is null."""
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return docs.select(
        "doc_id", *((F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items())
    )


def labelled_sample(labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, wanted, fold) of at most ``most`` labelled documents; one label per document, the worst."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    rows = (
        labels.filter("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min(good.cast("int")).alias("wanted"))
    )
    order = F.xxhash64("doc_id", F.lit("sample"))
    return rows.orderBy(order, "doc_id").limit(most).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(4)))


def find_signs(docs: DataFrame, sample: DataFrame) -> frozenset[str]:
    """Words and beginnings of words far more frequent in unwanted documents than in wanted ones."""
    # Of equal texts with different labels the worst counts.
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample.filter("fold <> 0").select("doc_id", "wanted")), "doc_id")
        .groupBy("text")
        .agg(F.min("wanted").alias("wanted"))
    )
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    begun = F.array_distinct(
        F.transform(
            F.filter("f", lambda w: F.length(w) > BEGINNING), lambda w: F.concat(F.lit("^"), F.substring(w, 1, BEGINNING))
        )
    )
    words = texts.select("wanted", found.alias("f")).select("wanted", F.explode(F.concat("f", begun)).alias("w"))
    totals = texts.agg(F.sum(1 - F.col("wanted")), F.sum("wanted")).first()
    bad, good = float(totals[0] or 0), float(totals[1] or 0)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    counts = words.groupBy("w").agg(F.sum(1 - F.col("wanted")).alias("a"), F.sum("wanted").alias("b"))
    odds = F.log(a / (bad + 1 - a)) - F.log(b / (good + 1 - b))

    # Root of the likelihood ratio; a standard error of the odds is no measure where no wanted document has the word.
    def surprise(seen, of: float) -> F.Column:
        share = (F.col("a") + F.col("b")) / (bad + good)
        return sum(F.when(n > 0, n * F.log(n / (of * p))).otherwise(0.0) for n, p in ((seen, share), (of - seen, 1 - share)))

    rows = (
        counts.filter(F.col("a") >= SIGN_DOCUMENTS)
        .withColumn("odds", odds)
        .withColumn("z", F.sqrt(F.greatest(F.lit(0.0), 2 * (surprise(F.col("a"), bad) + surprise(F.col("b"), good)))))
        .filter((F.col("z") >= SIGN_SCORE) & (F.col("odds") >= SIGN_ODDS))
        .orderBy(F.desc("z"), "w")
        .limit(SIGNS)
        .collect()
    )
    return frozenset(r.w for r in rows)


def _featured(docs: DataFrame, signs: frozenset[str]) -> DataFrame:
    """(doc_id, x, m) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(signs)

    def kernel(batches):
        for batch in batches:
            x, m = _both_views(batch, _NAMES, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(x.astype(np.float32))), pa.array(list(m.astype(np.float32)))],
                names=["doc_id", "x", "m"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(kernel, f"doc_id {kind}, x array<float>, m array<float>")


def _matrix(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _sums(rows: DataFrame, kernel_sums) -> np.ndarray:
    """Sums of the vectors that ``kernel_sums(batch)`` gives, over all rows."""

    def kernel(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = kernel_sums(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["sums"])

    sums = rows.mapInArrow(kernel, "sums array<double>").select(F.posexplode("sums").alias("i", "v"))
    got = sums.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r.v for r in got])


def _normal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    p = _sigmoid(x @ beta)
    w = weight * p * (1 - p) + 1e-9 * weight
    return np.concatenate([x.T @ (weight * (y - p)), ((x * w[:, None]).T @ x).ravel()])


def _stepped(beta: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    d = len(beta)
    gradient, hessian = sums[:d], sums[d:].reshape(d, d)
    ridge = RIDGE * max(n, 1)
    penalty = np.full(d, ridge)
    penalty[0] = 1e-6
    return beta + np.clip(np.linalg.solve(hessian + np.diag(penalty), gradient - penalty * beta), -4, 4)


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, rounds: int = ROUNDS) -> Model | None:
    """The model, or None without labelled documents of both kinds."""
    plain = _plain(docs)
    sample = stored(labelled_sample(labels, most))
    signs = find_signs(plain, sample)
    table = stored(_featured(plain, signs).join(F.broadcast(sample), "doc_id", "left"))
    # At most ``most`` rows of some dozen numbers: what is fitted on labels alone is fitted here.
    local = table.filter("wanted is not null").drop("doc_id").toArrow().combine_chunks()
    x, m = (
        local.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
        for c, size in (("x", TEXT_SIZE), ("m", META_SIZE))
    )
    y, fold = local.column("wanted").to_numpy().astype(float), local.column("fold").to_numpy()
    fit = fold != 0
    if len(set(y[fit])) < 2:
        return None
    n, weight = int(fit.sum()), fit.astype(float)
    beta_x, beta_m = np.zeros(TEXT_SIZE), np.zeros(META_SIZE)
    for _ in range(8):
        beta_x = _stepped(beta_x, _normal(x, y, weight, beta_x), n)
        beta_m = _stepped(beta_m, _normal(m, y, weight, beta_m), n)

    unlabelled = table.filter("wanted is null").select("x", "m")
    for _ in range(rounds):
        teach_x, teach_m = beta_x.copy(), beta_m.copy()
        for _ in range(3):
            at_x, at_m = beta_x.copy(), beta_m.copy()

            def taught(batch, at_x=at_x, at_m=at_m, teach_x=teach_x, teach_m=teach_m):
                x, m = _matrix(batch, "x", TEXT_SIZE), _matrix(batch, "m", META_SIZE)
                by_text, by_meta = _sigmoid(x @ teach_x), _sigmoid(m @ teach_m)
                sure_x, sure_m = (
                    PSEUDO_WEIGHT * ((p >= CONFIDENT) | (p <= 1 - CONFIDENT)) for p in (by_text, by_meta)
                )
                own_x = _normal(x, (by_meta > 0.5).astype(float), sure_m, at_x)
                return np.concatenate([own_x, _normal(m, (by_text > 0.5).astype(float), sure_x, at_m)])

            got = _sums(unlabelled, taught)
            cut = TEXT_SIZE + TEXT_SIZE**2
            more_x, more_m = (got[:cut], got[cut:]) if len(got) else (0, 0)
            beta_x = _stepped(beta_x, _normal(x, y, weight, beta_x) + more_x, n)
            beta_m = _stepped(beta_m, _normal(m, y, weight, beta_m) + more_m, n)

    # Calibration on the fold that no fit has seen: a scale and a shift for each view, then their weights.
    rest = ~fit
    z = [np.clip(v[rest] @ beta, -8, 8) for v, beta in ((x, beta_x), (m, beta_m))]
    scales = [_fitted(np.stack([np.ones(len(v)), v], 1), y[rest], np.array([0.0, 1.0])) for v in z]
    z = [s[0] + s[1] * v for s, v in zip(scales, z)]
    both = _fitted(np.stack([np.ones(len(z[0])), *z], 1), y[rest], np.array([0.0, 1.0, 0.0]))
    return Model(signs, *(tuple(map(float, v)) for v in (beta_x, beta_m, *scales, both)))


def _fitted(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Logistic regression from a starting point, which stays if one class is missing."""
    if len(set(y)) < 2:
        return beta
    for _ in range(10):
        beta = _stepped(beta, _normal(x, y, np.ones(len(y)), beta), len(y))
    return beta


def score(docs: DataFrame, model: Model | None, keep_at: float = 0.5) -> DataFrame:
    """``docs`` with one more column of structs (p_text, p_meta, score, n_signs, kept).

    The column is named ``quality_view``, with underscores before it if ``docs`` has that already.  Nulls in any
    column are features of their own; empty texts have no words; repeated rows are scored alike; an empty
    table gives none; texts are read whole.  Without a model every document scores 1 and is kept.
    """
    name = "quality_view"
    while name.lower() in (c.lower() for c in docs.columns):
        name = "_" + name
    made = "struct<p_text:double,p_meta:double,score:double,n_signs:int,kept:boolean>"
    if model is None:
        one = F.lit(1.0)
        same = F.struct(
            one.alias("p_text"), one.alias("p_meta"), one.alias("score"), F.lit(0).alias("n_signs"), F.lit(True).alias("kept")
        )
        return docs.withColumn(name, same.cast(made))
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.signs, model.text, model.meta, model.text_scale, model.meta_scale, model.combined)
    )

    def kernel(batches):
        signs, text, meta, scale_x, scale_m, both = shared.value
        for batch in batches:
            x, m = _both_views(batch, _NAMES, signs)
            z_x = scale_x[0] + scale_x[1] * np.clip(x @ np.array(text), -8, 8)
            z_m = scale_m[0] + scale_m[1] * np.clip(m @ np.array(meta), -8, 8)
            p = _sigmoid(both[0] + both[1] * z_x + both[2] * z_m)
            view = pa.StructArray.from_arrays(
                [pa.array(_sigmoid(z_x)), pa.array(_sigmoid(z_m)), pa.array(p), pa.array(x[:, 9].astype(np.int32)),
                 pa.array(p >= keep_at)],
                names=["p_text", "p_meta", "score", "n_signs", "kept"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, view], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(kernel, f"{fields}, `{name}` {made}")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, p_text, p_meta, score, n_signs, kept."""
    plain = _plain(docs)
    scored = score(plain, train(plain, labels))
    return scored.select("doc_id", f"{scored.columns[-1]}.*")
