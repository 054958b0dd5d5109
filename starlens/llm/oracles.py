"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from typing import NamedTuple

# The patterns and phrases of the definitions, written out here and not taken from the operators.


class _Rule(NamedTuple):
    kind: str
    pattern: str
    at_least: int
    group: int


RULES = (
    _Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    _Rule("access", r"AKIA[A-Z0-9]+", 20, 0),
    _Rule("hex", r"[0-9a-f]+", 24, 0),
    _Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 1, 0),
    _Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, 0),
    _Rule("maps", r"AIza[A-Za-z0-9_-]{35}", 1, 0),
    _Rule("payment", r"sk_live_[A-Za-z0-9]{16,}", 1, 0),
    _Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 1, 0),
    _Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
)
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies",
    "accept cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "sign up for our newsletter",
    "is licensed under the",
)
NAVIGATION = (
    r"^(home|menu|login|log in|sign in|sign up|search|next|previous|back to top|skip to content|share|read more|click here)"
    r"([^a-z]|\z)"
)
SENTENCE_END = r"""[.!?:;…。！？؟।]([\x20\x09-\x0D"'”’»)\]]|\z)"""

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3
    THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 85 * (min(x.n) + min(y.n) - count(*))),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id,
  s.doc_id = coalesce(c.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.a = s.doc_id
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM g),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
x AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS pos FROM h JOIN f USING (h) WHERE f.first < h.doc_id),
gone AS (SELECT doc_id, list(pos) AS gone FROM x GROUP BY doc_id),
k AS (
  SELECT w.doc_id, len(w.w) AS n, len(coalesce(gone.gone, [])) AS m, w.w, coalesce(gone.gone, []) AS gone
  FROM w LEFT JOIN gone USING (doc_id)),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
t AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS text
  FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.pos = e.pos WHERE x.pos IS NULL GROUP BY e.doc_id)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_words, CAST(k.m AS BIGINT) AS n_removed,
  sha256(coalesce(t.text, '')) AS kept_sha256
FROM k LEFT JOIN t USING (doc_id)
"""


def _secrets() -> str:
    found, lists = [], []
    for k, r in enumerate(RULES):
        p = _quoted(r.pattern)
        found.append(
            f"regexp_extract_all(text, {p}) AS m{k}, regexp_extract_all(text, {p}, {r.group}) AS c{k}, "
            f"string_split_regex(text, {p}) AS g{k}"
        )
        before = f"len(array_to_string(g{k}[1:i], '')) + len(array_to_string(m{k}[1:{{}}], ''))"
        lists.append(
            f"""list_transform(list_filter(range(1, len(m{k}) + 1), lambda i: len(c{k}[i]) >= {r.at_least}),
    lambda i: struct_pack(start := CAST({before.format("i - 1")} AS BIGINT), rank := {k},
      stop := CAST({before.format("i")} AS BIGINT), kind := '{r.kind}')) AS s{k}"""
        )
    line = "array_to_string(list_transform(list_sort({}), lambda x: x.kind || ':' || x.start || ':' || x.stop), ',')"
    joined = [f"s{k}" for k in range(len(RULES))]

    def concat(names):
        out = names[0]
        for n in names[1:]:
            out = f"list_concat({out}, {n})"
        return out

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS MATERIALIZED (SELECT doc_id, {", ".join(found)} FROM d),
s AS (SELECT doc_id, {", ".join(lists)} FROM f)
SELECT doc_id, CAST(len(s0) AS BIGINT) AS n_assign, CAST(len(s1) AS BIGINT) AS n_access,
  CAST(len(s2) AS BIGINT) AS n_hex, sha256({line.format(concat(joined[:3]))}) AS base_sha256,
  {line.format(concat(joined))} AS spans
FROM s
"""


SECRETS = _secrets()

_PHRASES = " OR ".join(f"contains(lower(l), {_quoted(p)})" for p in BOILERPLATE)

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM d),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
    unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS g
  FROM w WHERE len(w) >= 3),
twice AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM g JOIN twice USING (doc_id, g)),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
judged AS (
  SELECT doc_id, l, len(regexp_extract_all(l, '{_WORD}')) AS n,
    len(regexp_extract_all(l, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(l, '!!')) AS shouts,
    len(list_distinct(regexp_extract_all(l, '{_WORD}'))) AS different,
    ({_PHRASES}) AS boilerplate, regexp_matches(lower(l), {_quoted(NAVIGATION)}) AS navigation,
    regexp_matches(l, {_quoted(SENTENCE_END)}) AS closed,
    len(array_to_string(regexp_extract_all(l, '{_WORD}'), '')) AS chars
  FROM lines WHERE regexp_matches(l, '{_WORD}')),
passing AS (
  SELECT DISTINCT doc_id, l, chars FROM judged
  WHERE NOT (symbols * 4 >= n OR (n <= 3 AND navigation) OR boilerplate OR shouts * 2 >= n
    OR (n >= 12 AND NOT closed) OR (n >= 12 AND different * 3 < n))),
left_over AS (SELECT doc_id, sum(chars) AS chars FROM passing GROUP BY doc_id),
copies AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM judged GROUP BY doc_id),
base AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(copies.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(left_over.chars, 0) AS chars
  FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN copies USING (doc_id) LEFT JOIN left_over USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (word_chars - chars) <= 50 * word_chars AS kept
FROM base
"""

_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_BENCH_WORD}') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower("coalesce(text, '')")}, '{_BENCH_WORD}') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item, m, unnest(list_transform(range(1, len(w) - m + 2),
    lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
  FROM (SELECT item, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM p),
x AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i,
    unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
  FROM d, sizes WHERE len(w) >= m),
hits AS (SELECT x.doc_id, x.i, x.m, p.item FROM x JOIN p ON x.g = p.g AND x.m = p.m),
words AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

RANKED_SEARCH = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
docs AS (SELECT r, doc_id, len(w) AS n, w FROM w WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) GROUP BY ALL),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY t),
items AS (
  SELECT row_number() OVER () AS item, item_id,
    unnest(regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
asked AS (SELECT item, item_id, t, count(*) AS repeats FROM items GROUP BY ALL),
m AS (SELECT r, doc_id, 25 + (75 * n * total.docs) // total.terms AS m FROM docs, total),
scored AS (
  SELECT item, item_id, r, doc_id,
    CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN m USING (r)
  WHERE doc_id IS NOT NULL GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS t FROM d),
kept AS (
  SELECT lang, t, count(*) AS n FROM words GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS n FROM kept GROUP BY lang),
counts AS (
  SELECT lang, source, t, count(*) AS n FROM words JOIN kept USING (lang, t) GROUP BY lang, source, t),
groups AS (
  SELECT g.lang, g.source, coalesce(CAST(sum(c.n) AS HUGEINT), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.t, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (g.n + l.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, t)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, t AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
