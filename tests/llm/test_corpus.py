"""The corpus operators against brute force, and every awkward input."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from starlens.llm import (
    bpe,
    cotrain,
    decontaminate,
    langid,
    near_dup,
    pii,
    quality_rules,
    recompress,
    secret_scan,
    suffix_dedup,
)

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, kinds string, entities string"
LONG = "The quick brown fox jumps over the lazy dog near the river bank. " * 400
AWKWARD = [
    (1, None, None, None, None, 1, "x", "e"),
    (2, "", "en", "s", 0, 1, "x", "e"),
    (3, " \n\t ", "en", "s", 4, 1, "x", "e"),
    (4, "one two", "en", None, 7, 1, "x", "e"),
    (4, "one two", "en", None, 7, 1, "x", "e"),
    (None, "mail a.b@example.org now, token = abcdef123456", "en", "s", 9, 1, "x", "e"),
    (6, LONG, "en", "s", len(LONG), 1, "x", "e"),
    (7, LONG, "en", "s", len(LONG), 1, "x", "e"),
    (8, "1234 5678 !!", None, "s", 12, 1, "x", "e"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (7, 1, 0), (2, 0, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [("a", "Fox jumps over the lazy dog near the river bank the quick"), ("b", "one, two"), ("c", None), (None, "river")]
    return spark.createDataFrame(rows, "item_id string, text string")


def operators(labels, benchmark):
    return {
        "pii": lambda d: pii.replace_entities(d, "k"),
        "near": near_dup.near_duplicates,
        "lang": langid.identify_languages,
        "repeats": recompress.remove_repeats,
        "bpe": lambda d: bpe.encode_documents(d, VOCABULARY, public_tokenizers.PATTERN, with_ids=True),
        "secrets": secret_scan.scan_secrets,
        "bytes": suffix_dedup.remove_repeated_bytes,
        "rules": quality_rules.quality_rules,
        "classifier": lambda d: cotrain.classify(d, labels),
        "benchmark": lambda d: decontaminate.decontaminate(d, benchmark),
    }


@pytest.mark.parametrize(
    "name", ["pii", "near", "lang", "repeats", "bpe", "secrets", "bytes", "rules", "classifier", "benchmark"]
)
def test_awkward_rows_and_empty_tables(name, awkward, labels, benchmark):
    run = operators(labels, benchmark)[name]
    rows = run(awkward).collect()
    key = lambda x: (x is None, x)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in AWKWARD), key=key)
    assert run(awkward.limit(0)).collect() == []


def test_awkward_values(awkward, labels, benchmark):
    ops = operators(labels, benchmark)
    got = {n: {r.doc_id: r for r in ops[n](awkward).collect()} for n in ops}
    assert (got["near"][7].component_id, got["near"][7].kept, got["near"][2].n_shingles) == (6, False, 0)
    assert got["near"][None].component_id is None and got["near"][3].kept
    assert got["lang"][8].lang_pred == "und" and got["lang"][1].score == 0
    assert got["repeats"][7].n_removed == got["repeats"][7].n_words and got["repeats"][6].n_removed == 0
    assert got["bytes"][7].n_removed == got["bytes"][6].n_removed == len(LONG)
    assert got["bpe"][1].n_tokens == 0 and got["secrets"][None].n_assign == 1
    assert got["rules"][1].base_failed and not got["rules"][1].kept
    assert got["benchmark"][4].n_hit == 2 and got["benchmark"][1].n_words == 0
    assert "a.b@" not in got["pii"][None].text and got["pii"][1].text is None
    assert [c for c in ops["pii"](awkward).columns if c.endswith("entities")] == ["entities", "_entities"]


def test_surrogates_are_consistent_and_distinct(spark):
    rows = [
        (1, "Mr. John Smith, Frau Müller, г-жа Анна Петрова; a.b@x.org +1 (663) 555-6869 4111 1111 1111 1111"),
        (2, "A.B@x.org, +1 663 555 6869, 4111111111111111, 8.8.8.8"),
    ]
    rows += [(10 + i, f"Herr Name{chr(97 + i // 26)}{chr(97 + i % 26)} and 10.1.{i}.7") for i in range(200)]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    one, two = ({e.kind: e.surrogate for e in got[k].entities} for k in (1, 2))
    assert one["email"] == two["email"] and re.sub(r"\D", "", one["phone"]) == re.sub(r"\D", "", two["phone"])
    assert one["card"].replace(" ", "") == two["card"] and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", one["phone"])
    assert [e.surrogate.split()[0] for e in got[1].entities[:3]] == ["Mr.", "Frau", "г-жа"]
    assert re.fullmatch(r"г-жа [А-Я][а-я]+ [А-Я][а-я]+", got[1].entities[2].surrogate)
    every = {(e.kind, e.value): e.surrogate for k, r in got.items() if k > 2 for e in r.entities}
    assert len(every) == 400 == len(set(every.values())) and not set(every.values()) & {v for _, v in every}


def test_surrogates_of_whole_names(spark):
    texts = [
        "Mr John Otto Smith, Mr McDonald, Mr O'Brien and Mr. J. Smith met Dr. Ludwig van Beethoven.",
        "Mr Otto Quandt spoke; Mr Quandt left, MR. said Prof. Dr. Otto Quandt to Frau Hilda Quandt and Mr K. Smith. Mr QUANDT's hat.",
    ]
    got = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    got = {r.doc_id: r for r in got}
    people = {e.value: e.surrogate for r in got.values() for e in r.entities}
    assert set(people) == {
        "Mr John Otto Smith", "Mr McDonald", "Mr O'Brien", "Mr. J. Smith", "Dr. Ludwig van Beethoven", "Mr Otto Quandt",
        "Mr Quandt", "Prof. Dr. Otto Quandt", "Frau Hilda Quandt", "Mr K. Smith", "Mr QUANDT",
    }
    assert not re.search("John|Otto|Smith|Donald|Brien|Ludwig|Beethoven|(?i:Quandt)|Hilda", " ".join(r.text for r in got.values()))
    last = {v: s.split()[-1] for v, s in people.items()}
    assert last["Mr Quandt"] == last["Mr Otto Quandt"] == last["Frau Hilda Quandt"] and last["Mr QUANDT"] == last["Mr Quandt"].upper()
    assert people["Prof. Dr. Otto Quandt"] == people["Mr Otto Quandt"].replace("Mr", "Prof. Dr.")
    assert last["Mr. J. Smith"] == last["Mr John Otto Smith"] and people["Mr. J. Smith"][3:] != people["Mr K. Smith"][2:]
    assert len(set(people.values())) == len(people) and " van " in people["Dr. Ludwig van Beethoven"]


def _shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def test_near_duplicates_with_a_large_group(spark):
    rnd = random.Random(1)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    base = words(120)
    rows = []
    for i in range(250):
        w = list(base) if i < 200 else words(90)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = words(1)[0]
        rows.append((i, " ".join(w)))
        if i % 40 == 0:
            rows.append((1000 + i, " ".join(w)))
    got = {
        r.doc_id: r.component_id
        for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    }
    sets = {i: _shingles(t, 3) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [
        (a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert got == label


def test_near_duplicates_from_a_pool_of_passages(spark):
    # Buckets mix documents that share passages, so that most centres are far from a similar pair.
    rnd = random.Random(2)
    pool = [[f"w{rnd.randrange(10**6)}" for _ in range(8)] for _ in range(60)]
    rows, expected = [], {}
    for i in range(3000):
        w = sum((pool[k] for k in sorted(rnd.sample(range(60), 36))), [])
        rows.append((i, " ".join(w)))
        expected[i] = i
        if i >= 2940:
            for _ in range(6):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
            rows.append((i + 3000, " ".join(w)))
            expected[i + 3000] = i
    texts = dict(rows)
    pairs = [(_shingles(texts[i], 3), _shingles(texts[i - 3000], 3)) for i in texts if i >= 3000]
    assert len(pairs) == 60 and all(100 * len(a & b) >= 85 * len(a | b) for a, b in pairs)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == expected


def test_language_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in langid.identify_languages(docs).collect() if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.95 * len(held) > 0


def _periodic_rows(rnd):
    base = [" ".join(rnd.choice("a b c dd ee f".split()) for _ in range(rnd.randrange(40, 90))) for _ in range(12)]
    rows = []
    for i in range(200):
        noise = lambda n, m: [f"w{rnd.randrange(m)}" for _ in range(rnd.randrange(n))]
        t = " ".join([*noise(60, 10**6), rnd.choice(base)[rnd.randrange(9) :], *noise(60, 50)])
        kind = rnd.randrange(5)
        if kind == 0:
            t = " ".join([rnd.choice("xy")] * rnd.randrange(200)) + " " + t
        elif kind == 1:
            t = " ".join(rnd.choice("pq") for _ in range(300))
        elif kind == 2:
            t = rnd.choice(["m n o ", "u v ", "z "]) * rnd.randrange(100) + f" tail{rnd.randrange(3)}"
        rows.append((i, t))
    return rows


def test_repeated_words(spark):
    rows = _periodic_rows(random.Random(5))
    first, words = {}, {i: t.split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = {}
    for i, w in words.items():
        gone = {x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: tuple(r)[1:4] for r in recompress.remove_repeats(df).collect()} == want


@pytest.mark.parametrize("crowded", [suffix_dedup.CROWDED, 3])
def test_repeated_bytes(spark, crowded):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcdé fgh") for _ in range(rnd.randrange(150, 500))) for _ in range(8)]
    rows = []
    for i in range(120):
        b = rnd.choice(base)
        noise = lambda: "".join(rnd.choice("xyzw ") for _ in range(rnd.randrange(300)))
        t = noise() + b[rnd.randrange(30) : len(b) - rnd.randrange(30)] + noise()
        kind = rnd.randrange(5)
        t = rnd.choice(["a", "ab", "abc q"]) * rnd.randrange(200) + t if kind == 0 else b if kind == 1 else t
        rows.append((i, t))
    data = {i: t.encode() for i, t in rows}
    held = Counter(b[k : k + 200] for b in data.values() for k in range(len(b) - 199))
    want = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if held[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\x01" * 200
        spans = len(re.findall(b"\x01+", gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeated_bytes(df, crowded).collect()} == want


def test_loser_tree_merges_runs():
    rnd = random.Random(2)
    entries = sorted({bytes(rnd.choice(b"ab") for _ in range(suffix_dedup.SIZE)) for _ in range(300)})
    runs = [sorted(rnd.sample(entries, rnd.randrange(80))) for _ in range(7)]
    coded = [suffix_dedup.decoded(suffix_dedup.front_coded([(e, 1) for e in r])) for r in runs]
    got = list(suffix_dedup.merge(coded))
    assert [e for e, _, _ in got] == sorted(e for r in runs for e in r)
    for (a, _, _), (b, shared, _) in zip(got, got[1:]):
        assert shared == (suffix_dedup.SIZE if a == b else next(k for k in range(len(a)) if a[k] != b[k]))


def test_two_tokens_stand_side_by_side_as_merging_leaves_them():
    tokens = bpe.read_ranks(VOCABULARY)
    own, rng = bpe.Transducer(tokens), random.Random(5)
    ids = list(own.ranks.values())
    for _ in range(6000):
        joined = tokens[rng.choice(ids)] + tokens[rng.choice(ids)]
        cut = rng.randrange(1, len(joined))
        left, right = own.ranks.get(joined[:cut]), own.ranks.get(joined[cut:])
        if left is not None and right is not None and own._may_end(-1, left):
            assert own._may_end(left, right) == (own.merge(joined) == [left, right])


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    monkeypatch.setattr(bpe, "STATES", 5)
    monkeypatch.setattr(bpe, "AHEAD", 2)
    tokens = bpe.read_ranks(VOCABULARY)
    memo, library = bpe.Memo(tokens), tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks={t: i for i, t in enumerate(tokens) if t},
    )
    for piece in [" thndor", " ndor", "x" * 100, " thndor" * 30, " thndor", "ab" * 5000, "é", " 日本語", "\x00\n", " ndor", " untherapeutic"] * 2:
        ids = library.encode_ordinary(piece)
        if len(regex.findall(public_tokenizers.PATTERN, piece)) == 1:
            assert memo[piece] == " ".join(map(str, ids)) and piece not in memo.changed


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_is_the_librarys(name):
    tokens = bpe.read_ranks(public_tokenizers.path(name))
    own, back = bpe.Transducer(tokens), bpe.Decoder(tokens)
    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdefth ein\n\t 123😀日本éñ'sß---===") for _ in range(200)) for _ in range(200)]
    for text in [*texts, "a" * 3000, " " * 999, "<|endoftext|>", ""]:
        ids = [i for p in regex.findall(public_tokenizers.PATTERN, text) for i in own.encode(p.encode())]
        assert ids == other.encode_ordinary(text) and back.feed(ids) + back.finish() == text


def test_decoder_state_machine():
    rnd = random.Random(4)
    single = [bytes([i]) for i in range(256)]
    for _ in range(3000):
        data = bytes(rnd.choice(b"A\x80\xbf\xc2\xe0\xa0\xed\x9f\xf0\x90\xf4\x8f\xff\xc0") for _ in range(rnd.randrange(8)))
        decoder = bpe.Decoder(single)
        assert decoder.feed(data) + decoder.finish() == data.decode(errors="replace")


def test_trigram_queries():
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert secret_scan.trigram_query("[0-9a-f]+") is None
    assert sorted(secret_scan.trigram_query("abc?d|xyz")) == [["abc", "bcd"], ["abd"], ["xyz"]]


def test_benchmark_in_blocks(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontaminate.decontaminate(docs, bench).drop("spans", "items")
    many = decontaminate.decontaminate(docs, bench, block_bytes=1500).drop("spans", "items")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert one.filter("contaminated").count() > 0


def test_classifier_finds_what_is_unwanted(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = cotrain.classify(docs, labels).join(labels, "doc_id")
    wanted = (F.col("quality") == 1) & (F.col("toxic") == 0)
    row = got.agg(F.avg((F.col("kept") == wanted).cast("int")).alias("right"), F.avg(F.when(wanted, F.col("kept").cast("int"))).alias("clean")).first()
    assert row.right >= 0.93 and row.clean >= 0.95


def test_repeated_words_count_in_the_whole_text():
    rnd = random.Random(3)
    varied = [f"w{i}" for i in range(1000)]
    few = [rnd.choice("abcdefgh") for _ in range(1000)]
    share = lambda words: cotrain.text_features(" ".join(words), frozenset())[8]
    assert share(varied) == 0 and share(varied[:150] + few[:50]) == pytest.approx(42 / 200)
    assert share(varied[:200] + few) == pytest.approx(share(few + varied[:200])) == pytest.approx(960 / 1200)
    assert share(few[:200] + varied) == pytest.approx(192 / 1200)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SMALL)
        assert at.columns == docs.columns
    assert 0 < corpus_pipeline.run(spark, SMALL).count() < docs.count()
