"""Near-duplicate detection with SetSketch registers.

A document is the set of its word shingles.  A sketch holds, for each of its registers, the minimum of
exponential variates over the set, kept as a whole number on an exponentially spaced, truncated scale: sketches
of parts merge by the larger register, and similar sets agree in most registers.  Bands of registers propose
pairs, the joint likelihood of both sketches discards those that cannot be similar enough, and every
remaining pair is confirmed on the full sets.

Equal sets are one class from the start.  In a bucket of a band all classes are compared with its smallest
one, the centre, and the links found are closed to components.  Two members of a centre that these don't join
can only be similar if they share differences from the centre: with no shared difference, each is
at most as similar to the other as to the centre.  How many they must share follows from the sizes, so a prefix
of the rarest differences finds every such pair.  Members that are far from a centre propose pairs among the members of
its bucket by their own rarest shingles, of which similar sets share one.  No link between different texts is lost, and a
large group of copies never costs all of its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.llm.common import Words, as_bytes, by_value, chunks, mix, packed, release, stored, texts_of, unpacked
from starlens.llm.components import components

by_value(__name__)

REGISTERS = 150
ROWS = 5  # registers of a band: 30 bands miss a pair of similarity 0.85 (0.8) once in 40 million (150 thousand)
BASE = 1.15
OFFSET = 30
#: How far under the wanted similarity the estimate may be (over four standard errors) before a pair is dropped.
SLACK = 0.17
#: Rarest shingles of a member of a bucket that its rows carry.
EARLY = 32

_rng = np.random.default_rng(20_240_501)
_FACTORS = _rng.integers(1, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, REGISTERS, np.uint64)


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text (lower-cased A-Z, white-space words)."""
    w = Words(texts, lower=True)
    h = w.hashes
    n = len(h)
    wide = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        wide = wide * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(wide)]
    wide = mix(wide + np.uint64(size))
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= size:
            out.append(np.unique(wide[a : b - size + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for j in range(a, b):
                whole = whole * np.uint64(0x9E3779B97F4A7C15) + h[j]
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers (bytes) for each non-empty set."""
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    if not len(full):
        return out
    every = np.concatenate([sets[k] for k in full])
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    least = np.empty((len(full), REGISTERS), np.uint64)
    for r in range(REGISTERS):
        least[:, r] = np.minimum.reduceat(every * _FACTORS[r] + _SHIFTS[r], starts)
    uniform = (least.astype(np.float64) + 1) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53))
    out[full] = np.clip(np.floor(OFFSET + 1 - np.log(exponential) / np.log(BASE)), 0, 255).astype(np.uint8)
    return out


_GRID = np.linspace(0.0, 1.0, 101)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of most likelihood given both sketches (rows) and the sizes of both sets."""
    above = (a > b).sum(1)[:, None]
    below = (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    j = np.minimum(_GRID[None, :], np.minimum(u, 1 - u) / np.maximum(u, 1 - u))

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

    more, less = p(u - (1 - u) * j), p((1 - u) - u * j)
    equal = np.clip(1 - more - less, 1e-9, 1)
    score = above * np.log(more) + below * np.log(less) + (REGISTERS - above - below) * np.log(equal)
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def text_key(column: str) -> Column:
    """What tells rows of one doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, registers, text_key) for every row."""

    def kernel(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            counts, keys, registers = [], [], []
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi], size)
                counts += [len(s) for s in sets]
                keys += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                registers += [row.tobytes() for row in sketches(sets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(registers, pa.binary()), batch.column("text_key")],
                names=["doc_id", "n_shingles", "set_key", "registers", "text_key"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, set_key binary, registers binary, text_key long"
    return docs.withColumn("text_key", text_key("text")).mapInArrow(kernel, schema)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, members) of rows with a set."""

    def kernel(batches):
        for batch in batches:
            texts = unpacked(batch)
            ids = batch.column("doc_id")
            for lo, hi in chunks(texts):
                sets = shingle_sets(texts[lo:hi], size)
                lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists], names=["doc_id", "members"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(kernel, f"doc_id {kind}, members array<bigint>")


def _band_keys(registers: str) -> Column:
    bands = F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1))
    return F.transform(bands, lambda b: F.xxhash64(b, F.substring(F.col(registers), b * ROWS + 1, F.lit(ROWS))))


def _judged(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b, estimate) of ``pairs`` (a, b), with the similarity that the sketches give."""
    one = classes.select(F.col("rep").alias("a"), F.col("registers").alias("r_a"), F.col("n").alias("n_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("registers").alias("r_b"), F.col("n").alias("n_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "r_a", "r_b", "n_a", "n_b")

    def kernel(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                for c in ("r_a", "r_b")
            )
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            rows = batch.select(["a", "b", "n_a", "n_b"])
            yield rows.append_column("estimate", pa.array(estimate(a, b, n_a, n_b)))

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(kernel, f"a {kind}, b {kind}, n_a long, n_b long, estimate double")


def _bucket_pairs(members: DataFrame) -> DataFrame:
    """(key, centre, rep): each member of a bucket beside its centre, the smallest member.  ``members``: key, rep."""
    first = members.groupBy("key").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("held"))
    return members.join(first.filter("held > 1"), "key").filter("rep <> centre").select("key", "centre", "rep")


def _open_members(tried: DataFrame, judged: DataFrame, labels: DataFrame, near: float, sure: float) -> DataFrame:
    """(key, rep, label) of members that may be similar to one of their bucket whom their centre does not join to them.

    That needs a member far from the centre (estimate under ``near``), and both must be under ``sure``: whatever is
    similar to a member above is near to the centre too, and then both are in its star.  Buckets whose open members
    are of one component already have nothing to add.
    """
    known = judged.select(F.col("a").alias("centre"), F.col("b").alias("rep"), "estimate").filter(F.col("estimate") < sure)
    seen = (
        tried.join(known, ["centre", "rep"])
        .join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        .select("key", "rep", F.coalesce("label", "rep").alias("label"), "estimate")
    )
    mixed = (
        seen.groupBy("key")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("estimate").alias("least"))
        .filter((F.col("lo") < F.col("hi")) & (F.col("least") < near))
    )
    return seen.join(mixed.select("key"), "key", "left_semi").select("key", "rep", "label")


def _by_rare_shingles(open_ones: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of open members of a bucket, in different components, that may be similar enough.

    With t = num / (num + den), sets of n and m shingles that are similar share t (n + m), so the first of those, by
    rarity, is no later than place n + 1 - t (n + m) of either.  Up to there, for the smallest m that the bucket holds and that
    is not too small, shingles propose pairs inside the bucket.  Shingles that stand in the same members propose the same pairs: the rarest is enough, and none if all its
    members are of one component; that is so in the whole table, and once more in each bucket.  The first shingle that two
    members share is never left out that way, nothing before it is shared, and what is left from there on bounds what they
    share.  A pair is proposed in the first bucket of both, and there by its first shared shingle if both have it among
    their ``EARLY`` rarest; by every shared one otherwise.
    """
    t = num / (num + den)
    sizes = sets.select(F.col("doc_id").alias("rep"), F.size("members").alias("n"))
    sized = open_ones.join(sizes, "rep")
    least = sized.groupBy("key").agg(F.min("n").alias("least"))
    last = F.floor(F.col("n") + 1 - (F.col("n") + F.greatest("least", F.col("n") * (num / den))) * t + 1e-6)
    sized = stored(sized.join(least, "key").select("key", "rep", "label", last.alias("last")))
    wanted = sized.groupBy("rep", "label").agg(F.max("last").alias("last"))
    each = sets.join(wanted, sets.doc_id == wanted.rep).select(
        "rep", "label", "last", F.size("members").alias("n"), F.explode("members").alias("token")
    )
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy("rep").orderBy("times", "token")
    rare = (
        each.join(held, "token")
        .withColumn("place", F.row_number().over(order))
        .filter("place <= last and times > 1")
        .drop("last")
    )

    def proposers(rows: DataFrame, *bucket: str) -> DataFrame:
        """Rows of ``rows`` (rep, label, token, times) by the rarest shingle of those in the same, mixed members."""
        told = rows.groupBy(*bucket, "token").agg(
            F.min("times").alias("times"),
            F.min("label").alias("lo"),
            F.max("label").alias("hi"),
            F.count(F.lit(1)).alias("held"),
            F.bit_xor(F.xxhash64("rep")).alias("h"),
            F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("g"),
        )
        first = F.min(F.struct("times", "token")).getField("token").alias("token")
        one = told.filter("lo < hi").groupBy(*bucket, "held", "h", "g").agg(first)
        return rows.join(one.select(*bucket, "token"), [*bucket, "token"], "left_semi")

    rare = stored(rare)
    rows = proposers(rare).join(sized.select("key", "rep", "last"), "rep").filter("place <= last").drop("last")
    rows = stored(rows)
    chosen = stored(proposers(rows, "key"))
    keys = open_ones.groupBy("rep").agg(F.collect_set("key").alias("keys"))  # one for each band at most
    rarest = F.slice(F.sort_array(F.collect_list(F.struct("place", "token"))), 1, EARLY)
    early = chosen.groupBy("key", "rep").agg(F.transform(rarest, lambda e: e["token"]).alias("early"))
    proposing = chosen.join(early.join(keys, "rep"), ["key", "rep"])
    x, y = proposing.alias("x"), proposing.alias("y")
    shared = F.array_intersect("x.early", "y.early")
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    pairs = stored(
        x.join(
            y,
            (F.col("x.key") == F.col("y.key"))
            & (F.col("x.token") == F.col("y.token"))
            & (F.col("x.rep") < F.col("y.rep"))
            & (F.col("x.label") != F.col("y.label"))
            & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)
            & (most + 1e-6 >= (F.col("x.n") + F.col("y.n")) * t)
            & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))
            & (F.coalesce(F.get(shared, F.lit(0)), F.col("x.token")) == F.col("x.token")),
        )
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )
    release(sized, rare, rows, chosen)
    return pairs


def _sets_of(reps: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, members) of the documents in ``reps`` (doc_id)."""
    # One row of a class is enough, whichever of repeated rows it is.
    texts = packed(docs).join(reps.distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stored(_sets(texts, size))


def _with_sets(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b, common, m_a, m_b): those of ``near`` with their full sets."""
    first = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("m_a"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("m_b"))
    both = near.join(first, "a").join(second, "b")
    return both.withColumn("common", F.size(F.array_intersect("m_a", "m_b")))


def _linked(num: int, den: int) -> Column:
    return F.col("common") * den >= (F.col("n_a") + F.col("n_b") - F.col("common")) * num


def _across(stars: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (centre, a, b) of members of one centre, in different components, that may be similar enough.

    ``stars``: centre, rep, n_c, n, common, linked, differences.  For two members x and y the shared differences
    needed are s = t (n_x + n_y) - (common_x + common_y - n_c) with t = num / (num + den), and at least 1.
    ``needed`` is a lower bound of s over all partners that a member can have, so each pair shares one of the
    k - needed + 1 rarest differences of both.
    """
    t, tau = num / (num + den), num / den
    mixed = (
        stars.groupBy("centre")
        .agg(
            F.count(F.lit(1)).alias("held"),
            F.sum((~F.col("linked")).cast("int")).alias("apart"),
            F.min("n").alias("lo"),
            F.max("n").alias("hi"),
        )
        .filter("held > 1 and apart > 0")
    )
    members = stars.join(mixed.select("centre", "lo", "hi"), "centre").withColumn("k", F.size("differences"))
    least_n = F.greatest(F.col("n") * tau, F.col("lo"))
    most_n = F.least(F.col("n") / tau, F.col("hi"))
    # Bounds of t n_y - common_y: by common_y <= n_c; by s <= k_y; and, if x is linked, since y is not.
    rest = F.greatest(
        least_n * t - F.col("n_c"),
        (2 * t - 1) * (most_n if 2 * t < 1 else least_n) - F.col("common") + t * F.col("n"),
        F.when(F.col("linked"), -t * F.col("n_c")),
    )
    needed = F.greatest(F.ceil(F.col("n") * t - F.col("common") + F.col("n_c") + rest - 1e-6), F.lit(1))
    members = members.withColumn("prefix", F.col("k") - needed + 1)
    centres = members.groupBy("rep").agg(F.array_sort(F.collect_set("centre")).alias("centres"))
    each = members.select("centre", "rep", "prefix", F.explode("differences").alias("token"))
    held = each.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy("centre", "rep").orderBy("times", "token")
    prefixes = (
        each.join(held, ["centre", "token"])
        .withColumn("place", F.row_number().over(order))
        .filter("place <= prefix and times > 1")
        .select("centre", "rep", "token")
    )
    named = (
        members.select("centre", "rep", "n", "n_c", "k", "common", "linked")
        .join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        .join(centres, "rep")
        .withColumn("label", F.coalesce("label", "rep"))
    )
    rows = stored(prefixes.join(named, ["centre", "rep"]))
    x, y = rows.alias("x"), rows.alias("y")
    shared = (F.col("x.n") + F.col("y.n")) * t - (F.col("x.common") + F.col("y.common") - F.col("x.n_c"))
    return (
        x.join(
            y,
            (F.col("x.centre") == F.col("y.centre"))
            & (F.col("x.token") == F.col("y.token"))
            & (F.col("x.rep") < F.col("y.rep"))
            & (F.col("x.label") != F.col("y.label"))
            & ~(F.col("x.linked") & F.col("y.linked"))
            & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)
            & (shared <= F.least("x.k", "y.k") + 1e-6)
            & (F.element_at(F.array_intersect("x.centres", "y.centres"), 1) == F.col("x.centre")),
        )
        .select("x.centre", F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )


def _confirmed(pairs: DataFrame, stars: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of ``pairs`` (centre, a, b) that are linked.

    The full sets need not be read again: what both share of the centre and the differences they share give
    the size of their intersection exactly.
    """

    def side(name: str) -> DataFrame:
        return stars.select(
            "centre",
            F.col("rep").alias(name),
            F.col("n").alias(f"n_{name}"),
            F.col("common").alias(f"common_{name}"),
            F.col("differences").alias(f"differences_{name}"),
            *(["n_c"] if name == "a" else []),
        )

    both = pairs.join(side("a"), ["centre", "a"]).join(side("b"), ["centre", "b"])
    shared = F.size(F.array_intersect("differences_a", "differences_b"))
    common = F.col("common_a") + F.col("common_b") - F.col("n_c") + shared
    return both.withColumn("common", common).filter(_linked(num, den)).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, set_key, n_links, text_key.

    Sets of ``size``-word shingles (fewer words: the whole sequence) are linked if their similarity is at least
    num / den.  ``component_id`` is the smallest doc_id reachable, ``kept`` marks that document.  ``n_links``
    counts the confirmed links of the document's class to other classes that were needed to connect it.

    Null and empty texts have an empty set and are linked with nothing.  Rows that repeat a doc_id are one
    document: they share its component if their texts do.  A null doc_id is in no component (null) and not
    kept.  An empty table gives no rows; long texts have large sets, whole.
    """
    docs = texts_of(docs)
    base = stored(_sketched(docs, size))
    classes = stored(
        base.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.min("registers").alias("registers"), F.min("n_shingles").alias("n"))
    )
    keyed = classes.select("rep", "registers", "n").dropDuplicates(["rep"])
    members = keyed.select("rep", F.posexplode(_band_keys("registers")).alias("band", "key")).select("key", "rep")
    near, sure = num / den - 2 * SLACK, 1 - SLACK
    tried = stored(_bucket_pairs(members))
    judged = stored(_judged(tried.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), keyed))
    close = judged.filter(F.col("estimate") >= near)
    sets = _sets_of(close.select(F.col("a").alias("doc_id")).union(close.select("b")), docs, size)
    stars = stored(
        _with_sets(close, sets).select(
            F.col("a").alias("centre"),
            F.col("b").alias("rep"),
            F.col("n_a").alias("n_c"),
            F.col("n_b").alias("n"),
            "common",
            _linked(num, den).alias("linked"),
            F.concat(F.array_except("m_b", "m_a"), F.array_except("m_a", "m_b")).alias("differences"),
        )
    )
    release(sets)
    # Two centres of a bucket are members of each other.
    links = stars.filter("linked").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b"))
    links = stored(links.distinct())
    labels = components(links)
    more = stored(_confirmed(_across(stars, labels, num, den), stars, num, den))
    open_ones = stored(_open_members(tried, judged, labels, near, sure))
    release(tried, judged, stars)
    sets = _sets_of(open_ones.select(F.col("rep").alias("doc_id")), docs, size)
    asked = _by_rare_shingles(open_ones, sets, num, den)
    likely = _judged(asked, keyed).filter(F.col("estimate") >= num / den - SLACK)
    rest = stored(_with_sets(likely, sets).filter(_linked(num, den)).select("a", "b"))
    release(open_ones, sets, asked)
    every = links.union(more).union(rest).distinct()
    labels = components(every)
    degree = every.select(F.col("a").alias("rep")).union(every.select("b")).groupBy("rep").agg(
        F.count(F.lit(1)).alias("n_links")
    )
    found = (
        classes.select("set_key", "rep")
        .join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        .join(degree, "rep", "left")
        .select("set_key", F.coalesce("label", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return (
        base.drop("registers")
        .join(found, "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
            F.hex("set_key").alias("set_key"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            "text_key",
        )
    )
