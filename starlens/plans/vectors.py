"""C*: text, vectors, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.config import RETAIL
from starlens.functions.text import truncate_tokens
from starlens.functions.vectors import TermModel, cosine, embed, embed_queries
from starlens.operators import graph as gr
from starlens.operators import search
from starlens.plans.book import Book, with_star
from starlens.session import cut_lineage

book = Book()
DIMS = 64

# Hashed term frequencies of the texts in ``texts(id, text)``: one row per non-zero element.
HASHED = f"""tokens AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM texts),
counted AS (SELECT id, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % {DIMS} AS dim, count(*) AS n FROM tokens GROUP BY ALL),
vectors AS (SELECT id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS value FROM counted)"""

PAIRS = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, n.vec_id AS vec_id, q.label AS query_label, n.label AS label,
            round(list_cosine_similarity(q.e, n.e), 6) AS score,
            round(list_cosine_similarity(q.e[1:32], n.e[1:32]), 6) AS score_half FROM v q, v n)"""


def _elements(df, key):
    """Non-zero elements in long form."""
    long = df.select(key, F.posexplode("embedding").alias("dim", "value"))
    return long.filter("value <> 0").select(
        key, F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 5).alias("value")
    )


def hashed_idf(texts, corpus, dims):
    """SQL of the elements of ``texts``(id, text), weighted by the document frequencies of ``corpus``(id, text)."""
    return f"""texts AS ({texts}), corpus AS ({corpus}),
    tokens AS (SELECT 't' AS side, id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM texts
               UNION ALL SELECT 'c', id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM corpus),
    counted AS (SELECT side, id, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) % {dims} AS dim, count(*) AS n
                FROM tokens GROUP BY ALL),
    weights AS (SELECT dim, 1 + ln(((SELECT count(*) FROM corpus) + 1) / (count(*) + 1)) AS w
                FROM counted WHERE side = 'c' GROUP BY dim),
    weighted AS (SELECT id, dim, n * coalesce(w, 1 + ln((SELECT count(*) FROM corpus) + 1)) AS value
                 FROM counted LEFT JOIN weights USING (dim) WHERE side = 't'),
    vectors AS (SELECT id, dim, value / sqrt(sum(value * value) OVER (PARTITION BY id)) AS value FROM weighted)"""


_DOCS = "SELECT doc_id AS id, text FROM documents"
_WINDOW = r"""SELECT doc_id AS id,
  array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:256], ' ') AS text FROM documents"""


@book.query(
    "c1_embed_documents",
    f"""WITH {hashed_idf(_DOCS, _DOCS, DIMS)}
    SELECT id AS doc_id, dim, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 5) AS value FROM vectors""",
)
def c1(r):
    docs = r.table("documents").select("doc_id", "text")
    return _elements(embed(docs, "text", TermModel(DIMS).fitted(docs, "text")), "doc_id")


@book.query(
    "c1_embed_window",
    f"""WITH {hashed_idf(_WINDOW, _WINDOW, 384)}
    SELECT id AS doc_id, dim, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 5) AS value FROM vectors""",
)
def c1_window(r):
    """Size and window of the configured encoder."""
    docs = r.table("documents").select("doc_id", "text")
    model = TermModel.of(RETAIL.encoder).fitted(docs, "text")
    return _elements(embed(docs, "text", model), "doc_id")


@book.query(
    "c2_truncate_tokens",
    r"""
    WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:256] AS tokens FROM documents)
    SELECT doc_id, array_to_string(tokens, ' ') AS text, CAST(len(tokens) AS BIGINT) AS tokens FROM t""",
)
def c2(r):
    cut = r.table("documents").select("doc_id", truncate_tokens("text", 256).alias("text"))
    return cut.withColumn("tokens", F.size(F.split("text", " ")).cast("bigint"))


@book.query(
    "c3_embed_queries",
    f"""WITH {hashed_idf("SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'user'", _DOCS, DIMS)}
    SELECT id AS question_id, dim, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 5) AS value FROM vectors""",
)
def c3(r):
    model = TermModel(DIMS).fitted(r.table("documents"), "text")
    return _elements(embed_queries(user_turns(r), "question", model), "question_id")


def user_turns(r):
    return (
        r.table("conversations")
        .filter("role = 'user'")
        .select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
            F.col("text").alias("question"),
        )
    )


@book.query("c4_cosine", f"WITH {PAIRS} SELECT vec_id, score FROM pairs WHERE query_id = 0")
def c4(r):
    vectors = r.table("embeddings")
    first = vectors.filter("vec_id = 0").select("embedding").scalar()
    scored = vectors.withColumn("q", first)
    return scored.select("vec_id", F.round(cosine("embedding", "q"), 6).alias("score"))


@book.query(
    "c5_semantic_search",
    f"WITH {PAIRS} SELECT vec_id, score FROM pairs WHERE query_id = 0 ORDER BY score DESC, vec_id LIMIT 5",
)
def c5(r):
    vectors = r.table("embeddings")
    query = search.query_vector(vectors.filter("vec_id = 0"))
    return search.semantic_search(vectors, query, 5, key="vec_id")


_TOP5 = """top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs),
top_half AS (SELECT query_id, vec_id, score_half AS score,
               row_number() OVER (PARTITION BY query_id ORDER BY score_half DESC, vec_id) AS rank FROM pairs)"""


@book.query(
    "c6_batch_semantic_search",
    f"WITH {PAIRS}, {_TOP5} SELECT query_id, vec_id, score, rank FROM top WHERE rank <= 5",
)
def c6(r):
    vectors = r.table("embeddings").select("vec_id", "embedding")
    return search.batch_semantic_search(vectors, vectors, 5, key="vec_id", query_key="vec_id")


@book.query(
    "c6_knn_join",
    f"WITH {PAIRS}, {_TOP5} SELECT query_id, vec_id, score, rank FROM top WHERE rank <= 5",
)
def c6_join(r):
    vectors = r.table("embeddings")
    return search.batch_semantic_search(vectors, vectors, 5, key="vec_id", query_key="vec_id", pivots=32, block=128)


@book.query(
    "c6_similar_documents",
    f"""WITH {hashed_idf(_DOCS, _DOCS, DIMS)},
    pairs AS (SELECT q.id AS query_id, n.id AS doc_id, round(sum(q.value * n.value), 6) AS score
              FROM vectors q JOIN vectors n ON q.dim = n.dim GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs)
    SELECT query_id, doc_id, score, rank FROM top WHERE rank <= 5""",
)
def c6_documents(r):
    """The nearest texts of every document with a term."""
    docs = r.table("documents").select("doc_id", "text")
    embedded = embed(docs, "text", TermModel(DIMS).fitted(docs, "text"), element="double").drop("text")
    embedded = cut_lineage(embedded).filter(F.exists("embedding", lambda x: x != 0))
    return search.batch_semantic_search(embedded, embedded, 5, key="doc_id", query_key="doc_id")


@book.query(
    "c7_filtered_search",
    f"WITH {PAIRS} SELECT vec_id, score FROM pairs WHERE query_id = 0 AND label = 3 ORDER BY score DESC, vec_id LIMIT 5",
)
def c7(r):
    vectors = r.table("embeddings")
    query = search.query_vector(vectors.filter("vec_id = 0"))
    return search.semantic_search(vectors, query, 5, key="vec_id", where=F.col("label") == 3)


@book.star(
    "c8_keyword_search_items",
    """
    SELECT DISTINCT item_name, item_description FROM items
    WHERE lower(item_name) LIKE '%plate%' OR lower(item_description) LIKE '%plate%'""",
)
def c8(r):
    return search.keyword_search(r.items(), "Plate", ["item_name", "item_description"])


@book.query(
    "c8_keyword_search_documents",
    "SELECT DISTINCT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')",
)
def c8_documents(r):
    return search.keyword_search(r.table("documents"), "license", ["text", "source"], ["doc_id", "lang"])


_QUESTION = "Show me red plate items"


@book.query(
    "c9_search_recall",
    with_star(f"""
    , texts AS (
      SELECT CAST(item_id AS VARCHAR) AS id, concat_ws(' | ', 'item_id: ' || item_id, 'item_name: ' || item_name,
             'item_description: ' || item_description) AS text FROM items
      UNION ALL SELECT 'q', '{_QUESTION}'),
    {HASHED},
    scored AS (SELECT n.id, round(sum(n.value * q.value), 6) AS score FROM vectors n JOIN vectors q ON n.dim = q.dim
               WHERE q.id = 'q' AND n.id <> 'q' GROUP BY n.id),
    semantic AS (SELECT 'item_details_' || id AS node_id, id FROM scored ORDER BY score DESC, node_id LIMIT 20)
    SELECT count(*) AS hits, count(*) FILTER (item_name LIKE '%plate%') AS in_keyword_hits,
           count(*) FILTER (item_name LIKE '%plate%') / count(*) AS share
    FROM semantic JOIN items ON id = CAST(item_id AS VARCHAR)"""),
)
def c9(r):
    nodes = gr.build_nodes({"item_details": r.items()})
    embedded = embed(nodes.select("node_id", "node_text"), "node_text", TermModel(DIMS), element="double")
    question = nodes.limit(1).select(F.lit(_QUESTION).alias("question"))
    query = search.query_vector(embed_queries(question, "question", TermModel(DIMS), element="double"))
    semantic = search.semantic_search(embedded, query, 20)
    keyword = search.keyword_search(nodes, "plate", ["item_name", "item_description"], ["node_id"])
    return search.search_recall(semantic, keyword, "node_id")


@book.query(
    "c9_precision_at_k",
    f"""WITH {PAIRS}, {_TOP5}
    SELECT query_id, count(*) AS hits, count(*) FILTER (query_label = label) AS same_label
    FROM top WHERE rank <= 5 GROUP BY query_id""",
)
def c9_labels(r):
    return search.precision_at_k(c6(r), r.table("embeddings"), "vec_id", "label")


@book.query(
    "c10_compare_embedding_spaces",
    f"""WITH {PAIRS}, {_TOP5},
    a AS (SELECT * FROM top WHERE rank <= 5), b AS (SELECT * FROM top_half WHERE rank <= 5)
    SELECT coalesce(a.query_id, b.query_id) AS query_id, count(*) FILTER (a.score IS NOT NULL AND b.score IS NOT NULL) AS shared,
           count(a.score) AS hits_a, count(b.score) AS hits_b, round(avg(a.score), 8) AS avg_score_a,
           round(avg(b.score), 8) AS avg_score_b, round(avg(a.score - b.score), 8) AS score_delta,
           count(*) FILTER (a.score IS NOT NULL AND b.score IS NOT NULL) / 5 AS overlap
    FROM a FULL JOIN b ON a.query_id = b.query_id AND a.vec_id = b.vec_id GROUP BY 1""",
)
def c10(r):
    full = r.table("embeddings").select("vec_id", "embedding")
    half = full.withColumn("embedding", F.slice("embedding", 1, 32))
    ranks = [
        search.batch_semantic_search(space, space, 5, key="vec_id", query_key="vec_id") for space in (full, half)
    ]
    out = search.compare_embedding_spaces(*ranks, "vec_id")
    means = ("avg_score_a", "avg_score_b", "score_delta")
    return out.withColumns({c: F.round(c, 8) for c in means})


@book.query(
    "c11_embedding_storage_stats",
    """SELECT count(*) AS vectors, max(len(embedding)) AS dims, CAST(sum(len(embedding)) * 4 AS BIGINT) AS bytes
    FROM embeddings""",
)
def c11(r):
    return search.embedding_storage_stats(r.table("embeddings"))
