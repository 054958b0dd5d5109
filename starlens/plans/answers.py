"""I*, J1, J4: answer texts, batch answering, result comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions import questions as qs
from starlens.functions import render
from starlens.functions.vectors import TermModel, embed
from starlens.operators import aggregates as agg
from starlens.operators import evaluate as ev
from starlens.operators import graph as gr
from starlens.operators import patterns as pat
from starlens.operators import search
from starlens.operators.answers import AGGREGATION_NOTE, NO_MENTION, answer_batch, answer_relations, answer_simple
from starlens.plans.book import Book, with_star
from starlens.plans.graph import dims
from starlens.plans.log import QUESTIONS, question_log
from starlens.plans.questions import _MONTH_WORD, _QUARTER, _TOPN, _YEAR, INTENT, _any
from starlens.plans.vectors import _TOP5, DIMS, HASHED, PAIRS
from starlens.session import cut_lineage
from starlens.sources.retail import denormalize

book = Book()
V = "total_sales_value"


@book.query(
    "i1_semantic_lines",
    f"""WITH {PAIRS}, {_TOP5},
    lines AS (SELECT query_id, rank, '- vec_id: ' || vec_id || ', label: ' || (SELECT label FROM v WHERE v.vec_id = top.vec_id)
                || ' (relevance: ' || format('{{:.3f}}', score) || ')' AS line FROM top WHERE rank <= 5)
    SELECT query_id, 'Most relevant items:' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS answer
    FROM lines GROUP BY query_id""",
)
def i1(r):
    vectors = r.table("embeddings")
    nodes = vectors.select(
        "vec_id",
        "embedding",
        F.concat(F.lit("vec_id: "), "vec_id", F.lit(", label: "), "label").alias("node_text"),
    )
    ranked = search.batch_semantic_search(nodes, vectors, 5, key="vec_id", query_key="vec_id")
    lines = render.semantic_lines(ranked, nodes, key="vec_id")
    return render.semantic_answers(vectors.select(F.col("vec_id").alias("query_id")), lines)


_TOP_ITEMS = """, top AS (
      SELECT item_id, item_name, sum(total_sales_value) AS revenue, sum(units_sold) / count(*) AS mean_units, count(*) AS n,
             row_number() OVER (ORDER BY sum(total_sales_value) DESC, item_id) AS position
      FROM sales JOIN items USING (item_id) GROUP BY item_id, item_name ORDER BY position LIMIT 10)"""


def _top_items(r):
    fact = r.sales("item_id", "units_sold", V)
    per_item = fact.groupBy("item_id").agg(
        F.sum(V).alias("revenue"), F.avg("units_sold").alias("mean_units"), F.count(F.lit(1)).alias("n")
    )
    best = per_item.join(r.items().select("item_id", "item_name"), "item_id")
    numbered = pat.preview(best, [F.desc("revenue"), F.asc("item_id")], 10).drop("more")
    return numbered.select("position", "item_id", "item_name", "revenue", "mean_units", "n")


_FLOAT = "regexp_replace(format('{{:,.6f}}', {0}), '(\\.\\d+?)0+$', '\\1')"


@book.star(
    "i2_result_lines",
    f"""{_TOP_ITEMS}
    SELECT position, position || '. item_id: ' || format('{{:,}}', item_id) || ', item_name: ' || item_name || ', revenue: $'
      || format('{{:,.2f}}', revenue) || ', mean_units: ' || {_FLOAT.format('mean_units')} || ', n: ' || format('{{:,}}', n) AS line
    FROM top""",
)
def i2(r):
    return render.result_lines(_top_items(r))


@book.star(
    "i2_empty_result",
    "SELECT CASE WHEN count(*) = 0 THEN 'No results found for: Items above a billion' END AS answer FROM "
    "(SELECT item_id FROM sales GROUP BY item_id HAVING sum(total_sales_value) > 1e9)",
)
def i2_empty(r):
    rich = _top_items(r).filter("revenue > 1e9")
    return render.result_answer(rich, "Items above a billion")


_WHEN = "in Q4 2000"


def _buyers_text(found: str, title: str, nobody: str) -> str:
    """SQL of one answer: title and either the first ten buyers of the table ``found`` or ``nobody``."""
    return f"""
    SELECT '{title} {_WHEN}:' || chr(10) || CASE WHEN (SELECT count(*) FROM {found}) = 0 THEN {nobody} ELSE
      'Found ' || (SELECT count(*) FROM {found}) || ' customers:' || chr(10)
      || (SELECT string_agg(p || '. ' || customer_name || ' (ID: ' || customer_id || ') - ' || customer_segment, chr(10) ORDER BY p)
          FROM (SELECT *, row_number() OVER (ORDER BY customer_id) AS p FROM customers
                WHERE customer_id IN (SELECT customer_id FROM {found})) WHERE p <= 10)
      || CASE WHEN (SELECT count(*) FROM {found}) > 10 THEN chr(10) || '... and '
         || ((SELECT count(*) FROM {found}) - 10) || ' more customers' ELSE '' END END AS answer"""


@book.star(
    "i3_bought_lines",
    f"""
    , a AS (SELECT DISTINCT customer_id FROM sales JOIN items USING (item_id) WHERE item_name LIKE '%red plate%'
            AND year(sale_date) = 2000 AND quarter(sale_date) = 4),
    b AS (SELECT DISTINCT customer_id FROM sales JOIN items USING (item_id) WHERE item_name LIKE '%small widget%'
          AND year(sale_date) = 2000 AND quarter(sale_date) = 4),
    ab AS (SELECT customer_id FROM a JOIN b USING (customer_id))
    {_buyers_text('a', "Customers who bought ''red plate''", f"'No customers found who purchased this product {_WHEN}.'")}
    UNION ALL
    {_buyers_text(
        'ab',
        "Customers who bought both ''red plate'' AND ''small widget''",
        f"""'No customers found who purchased both products {_WHEN}.' || chr(10) || 'Note:' || chr(10)
        || '  • ' || (SELECT count(*) FROM a) || ' customers bought ''red plate'' {_WHEN}' || chr(10)
        || '  • ' || (SELECT count(*) FROM b) || ' customers bought ''small widget'' {_WHEN}'""",
    )}
    UNION ALL SELECT 'Product ''purple plate'' not found'""",
)
def i3(r):
    fact, when = r.sales("item_id", "customer_id", "sale_date"), dict(year=2000, quarter=4)
    parts = []
    for a, b in (("red plate", None), ("red plate", "small widget"), ("purple plate", None)):
        summary = pat.relation_summary(fact, r.items(), a, b, **when)
        if b is None:
            who = pat.customers_who_bought(fact, r.items(), r.customers(), a, **when)
        else:
            who = pat.customers_who_bought_both(fact, r.items(), r.customers(), a, b, **when)
        first = pat.preview(who, "customer_id")
        parts.append(render.bought_lines(summary, first, contact="customer_segment", **when))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@book.star(
    "i4_top_lines",
    """
    , t AS (SELECT item_name, sum(units_sold) AS u, count(*) AS n, row_number() OVER (ORDER BY sum(units_sold) DESC, item_id) AS p
            FROM sales JOIN items USING (item_id) WHERE year(sale_date) = 2000 AND month(sale_date) = 12
            GROUP BY item_id, item_name)
    SELECT 'Top 5 item details in December 2000 by units_sold:' || chr(10) || string_agg(
      p || '. ' || item_name || ' - ' || format('{:,.0f}', u) || ' units (' || n || ' transactions)', chr(10) ORDER BY p) AS answer
    FROM t WHERE p <= 5""",
)
def i4(r):
    fact = r.sales("item_id", "sale_date", "units_sold")
    best = agg.top_n_with_count(fact, r.items(), "item_id", "item_name", "units_sold", year=2000, month=12)
    numbered = pat.preview(best, [F.desc("units_sold"), F.asc("item_id")], 5)
    return render.top_answer(numbered, "item_name", "units_sold", "units_sold", "item_details", 5, 2000, 12)


@book.star(
    "i4_top_lines_revenue",
    """
    , t AS (SELECT location_name, sum(total_sales_value) AS v, count(*) AS n,
              row_number() OVER (ORDER BY sum(total_sales_value) DESC, location_id) AS p
            FROM sales JOIN locations USING (location_id) GROUP BY location_id, location_name)
    SELECT p AS position, p || '. ' || location_name || ' - $' || format('{:,.2f}', v) || ' (' || n || ' transactions)' AS line
    FROM t WHERE p <= 5""",
)
def i4_revenue(r):
    best = agg.top_n_with_count(r.sales("location_id", V), r.locations(), "location_id", "location_name", V)
    numbered = pat.preview(best, [F.desc(V), F.asc("location_id")], 5)
    return render.top_lines(numbered, "location_name", V, V)


def search_nodes(r):
    """Node texts and vectors of the whole graph, commas between attributes."""
    nodes = gr.build_nodes(dims(r), sep=", ").select("node_id", "node_text")
    return cut_lineage(embed(nodes, "node_text", TermModel(DIMS), element="double"))


_QUOTED = """list_transform(regexp_extract_all(question, '("[^"]+"|(?:^|\\s)''[^'']+'')', 1),
    lambda m: regexp_replace(regexp_replace(m, '^\\s*["'']', ''), '["'']$', ''))"""
_IDS = "regexp_extract_all(question, '(?i)\\b([a-z]-\\d+)\\b', 1)"
_NOTE = AGGREGATION_NOTE.replace("\n", "' || chr(10) || '")


@book.query(
    "j1_answer_batch",
    with_star(f"""
    , {QUESTIONS},
    asked AS (SELECT question, CASE WHEN {_any(qs.AGGREGATION_WORDS)} THEN 'aggregation'
                WHEN {_any(qs.PATTERN_PHRASES)} THEN 'pattern' ELSE 'semantic' END AS route
              FROM (SELECT DISTINCT question FROM questions)),
    node_texts AS (
      SELECT 'item_details_' || item_id AS node_id, 'item_id: ' || item_id || ', item_name: ' || item_name
        || ', item_description: ' || item_description AS text FROM items
      UNION ALL SELECT 'supplier_details_' || s_suppkey, 'supplier_id: ' || s_suppkey || ', supplier_name: ' || s_name
        || ', supplier_nation: ' || s_nationkey FROM supplier
      UNION ALL SELECT 'customer_details_' || customer_id, 'customer_id: ' || customer_id || ', customer_name: ' || customer_name
        || ', customer_segment: ' || customer_segment || ', customer_nation: ' || customer_nation FROM customers),
    texts AS (SELECT 'n' || node_id AS id, text FROM node_texts
              UNION ALL SELECT 'q' || question, question FROM asked WHERE route <> 'pattern'),
    {HASHED},
    dots AS (SELECT q.id AS qid, n.id AS nid, sum(q.value * n.value) AS s FROM vectors q JOIN vectors n ON q.dim = n.dim
             WHERE q.id[1] = 'q' AND n.id[1] = 'n' GROUP BY ALL),
    scored AS (SELECT a.question, t.node_id, t.text, round(coalesce(s, 0), 6) AS score
               FROM asked a, node_texts t LEFT JOIN dots ON qid = 'q' || a.question AND nid = 'n' || t.node_id
               WHERE a.route <> 'pattern'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, node_id) AS rank FROM scored
               QUALIFY rank <= 5),
    semantic AS (SELECT question, 'Most relevant items:' || chr(10) || string_agg('- ' || text || ' (relevance: '
                   || format('{{:.3f}}', score) || ')', chr(10) ORDER BY rank) AS answer FROM ranked GROUP BY question),
    mentions AS (SELECT question, CASE WHEN len({_QUOTED}) > 0 THEN {_QUOTED} ELSE {_IDS} END AS ms FROM asked WHERE route = 'pattern'),
    each AS (SELECT DISTINCT question, unnest(ms) AS mention FROM mentions),
    wanted AS (SELECT DISTINCT lower(mention) AS m FROM each),
    first AS (SELECT m, min(item_id) AS item_id FROM wanted JOIN items ON contains(lower(item_name), m)
                OR lower(CAST(item_id AS VARCHAR)) = m GROUP BY m),
    bought AS (SELECT DISTINCT item_id, customer_id FROM sales WHERE item_id IN (SELECT item_id FROM first)),
    buyers AS (SELECT DISTINCT question, customer_id FROM each JOIN first ON lower(mention) = m JOIN bought USING (item_id)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY customer_id) AS p,
                   count(*) OVER (PARTITION BY question) AS n FROM buyers),
    listed AS (SELECT question, max(n) AS n, string_agg(p || '. ' || customer_name || ' (ID: ' || customer_id || ')', chr(10) ORDER BY p) AS body
               FROM numbered JOIN customers USING (customer_id) WHERE p <= 10 GROUP BY question),
    relations AS (
      SELECT question, CASE WHEN len(ms) = 0 THEN '{NO_MENTION}'
        WHEN NOT EXISTS (SELECT 1 FROM each e JOIN first ON lower(e.mention) = m WHERE e.question = mentions.question)
          THEN 'Product ''' || ms[1] || ''' not found'
        WHEN n IS NULL THEN 'No customers found who bought ''' || ms[1] || ''''
        ELSE 'Customers who bought ''' || ms[1] || ''':' || chr(10) || 'Found ' || n || ' customers:' || chr(10) || body
          || CASE WHEN n > 10 THEN chr(10) || '... and ' || (n - 10) || ' more customers' ELSE '' END END AS answer
      FROM mentions LEFT JOIN listed USING (question)),
    answers AS (
      SELECT question, route, CASE WHEN route = 'aggregation' THEN '{_NOTE}' ELSE '' END || answer AS answer
      FROM asked JOIN semantic USING (question)
      UNION ALL SELECT question, route, answer FROM asked JOIN relations USING (question))
    SELECT question_id, route, answer FROM questions JOIN answers USING (question)"""),
)
def j1(r):
    return answer_batch(
        question_log(r).select("question_id", "question"),
        search_nodes(r),
        r.sales("item_id", "customer_id"),
        r.items(),
        r.customers(),
        TermModel(DIMS),
        element="double",
    )


_WHEN = """CASE WHEN year IS NULL THEN '' WHEN month IS NOT NULL THEN ' in ' || strftime(make_date(2000, month, 1), '%B') || ' ' || year
  WHEN quarter IS NOT NULL THEN ' in Q' || quarter || ' ' || year ELSE ' in ' || year END"""


@book.query(
    "j1_answer_simple",
    with_star(f"""
    , {INTENT},
    asked AS (
      SELECT question_id, entity_type, measure, {_any(qs.BOTTOM_WORDS)} AS is_bottom, {_YEAR} AS year, {_MONTH_WORD} AS month,
        {_QUARTER} AS quarter, CAST(coalesce(nullif(regexp_extract(lower(question), '{_TOPN}', 1)
          || regexp_extract(lower(question), '{_TOPN}', 2), ''), '5') AS BIGINT) AS n
      FROM routed WHERE route = 'simple'),
    months AS (
      SELECT 'item_details' AS entity_type, item_id AS key, sale_date, units_sold, total_sales_value FROM sales
      UNION ALL SELECT 'store_location', location_id, sale_date, units_sold, total_sales_value FROM sales
      UNION ALL SELECT 'customer_details', customer_id, sale_date, units_sold, total_sales_value FROM sales),
    monthly AS (SELECT entity_type, key, year(sale_date) AS y, month(sale_date) AS m, sum(units_sold) AS u,
                  sum(total_sales_value) AS v, count(*) AS c FROM months GROUP BY ALL),
    periods AS (SELECT DISTINCT entity_type, year, month, quarter FROM asked),
    totals AS (SELECT p.*, key, sum(u) AS u, sum(v) AS v, sum(c) AS c FROM periods p JOIN monthly t
               ON p.entity_type = t.entity_type AND (year IS NULL OR year = y) AND (month IS NULL OR month = m)
                 AND (quarter IS NULL OR quarter = (m + 2) // 3) GROUP BY ALL),
    labels AS (SELECT 'item_details' AS entity_type, item_id AS key, item_name AS label FROM items
               UNION ALL SELECT 'store_location', location_id, location_name FROM locations
               UNION ALL SELECT 'customer_details', customer_id, customer_name FROM customers),
    intents AS (SELECT DISTINCT * EXCLUDE (question_id) FROM asked),
    valued AS (SELECT i.*, t.key, label, CASE measure WHEN 'COUNT(*)' THEN c WHEN 'units_sold' THEN u ELSE v END AS value
               FROM intents i JOIN totals t ON i.entity_type = t.entity_type AND i.year IS NOT DISTINCT FROM t.year
                 AND i.month IS NOT DISTINCT FROM t.month AND i.quarter IS NOT DISTINCT FROM t.quarter
               JOIN labels l ON l.entity_type = t.entity_type AND l.key = t.key),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_type, measure, is_bottom, year, month, quarter, n
                 ORDER BY CASE WHEN is_bottom THEN value ELSE -value END, key) AS p FROM valued),
    lists AS (SELECT entity_type, measure, is_bottom, year, month, quarter, n, string_agg(p || '. ' || label || ' - ' ||
                CASE measure WHEN 'total_sales_value' THEN '$' || format('{{:,.2f}}', value)
                  WHEN 'COUNT(*)' THEN format('{{:,}}', CAST(value AS BIGINT)) || ' transactions'
                  ELSE format('{{:,.0f}}', value) || ' units' END, chr(10) ORDER BY p) AS body
              FROM ranked WHERE p <= n GROUP BY ALL)
    SELECT question_id, CASE WHEN body IS NULL THEN 'No data found for the specified filters' || {_WHEN} || '.'
      ELSE CASE WHEN is_bottom THEN 'Bottom ' ELSE 'Top ' END || n || ' ' || replace(entity_type, '_', ' ') || {_WHEN}
        || ' by ' || measure || ':' || chr(10) || body END AS answer
    FROM (SELECT a.*, body FROM asked a LEFT JOIN lists l ON a.entity_type = l.entity_type AND a.measure = l.measure
      AND a.is_bottom = l.is_bottom AND a.n = l.n AND a.year IS NOT DISTINCT FROM l.year
      AND a.month IS NOT DISTINCT FROM l.month AND a.quarter IS NOT DISTINCT FROM l.quarter)"""),
)
def j1_simple(r):
    dims = {"item_details": r.items(), "store_location": r.locations(), "customer_details": r.customers()}
    fact = r.sales("item_id", "location_id", "customer_id", "sale_date", "units_sold", V)
    return answer_simple(question_log(r).select("question_id", "question"), fact, dims)


def _equal(a, b, *columns):
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in columns)


_RELATION = ("item_a", "item_b", "year", "month", "quarter")


@book.query(
    "j1_answer_dated_pairs",
    with_star(f"""
    , {QUESTIONS},
    asked AS (SELECT question, {_YEAR} AS year, {_MONTH_WORD} AS month, {_QUARTER} AS quarter,
                CASE WHEN len({_QUOTED}) > 0 THEN {_QUOTED} ELSE {_IDS} END AS ms
              FROM (SELECT DISTINCT question FROM questions) WHERE {_any(qs.PATTERN_PHRASES)}),
    mentions AS (SELECT DISTINCT lower(unnest(ms[1:2])) AS m FROM asked),
    first AS (SELECT m, min(item_id) AS item_id FROM mentions JOIN items ON contains(lower(item_name), m)
                OR lower(CAST(item_id AS VARCHAR)) = m GROUP BY m),
    f AS (SELECT asked.*, {_WHEN} AS w, a.item_id AS item_a, b.item_id AS item_b FROM asked
          LEFT JOIN first a ON a.m = lower(ms[1]) LEFT JOIN first b ON b.m = lower(ms[2])),
    k AS (SELECT DISTINCT item_a, item_b, year, month, quarter FROM f
          WHERE item_a IS NOT NULL AND (len(ms) < 2 OR item_b IS NOT NULL)),
    bought AS (SELECT DISTINCT item_id, customer_id, year(sale_date) AS y, month(sale_date) AS m FROM sales),
    folded AS (SELECT k.*, customer_id, bool_or(item_id = item_a) AS a, bool_or(item_b IS NULL OR item_id = item_b) AS b
               FROM k JOIN bought ON (item_id = item_a OR item_id = item_b) AND (year IS NULL OR year = y)
                 AND (month IS NULL OR month = m) AND (quarter IS NULL OR quarter = (m + 2) // 3) GROUP BY ALL),
    counts AS (SELECT item_a, item_b, year, month, quarter, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b,
                 count(*) FILTER (a AND b) AS n FROM folded GROUP BY ALL),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY item_a, item_b, year, month, quarter ORDER BY customer_id) AS p
                 FROM folded WHERE a AND b),
    lists AS (SELECT item_a, item_b, year, month, quarter,
                string_agg(p || '. ' || customer_name || ' (ID: ' || customer_id || ')', chr(10) ORDER BY p) AS body
              FROM numbered JOIN customers USING (customer_id) WHERE p <= 10 GROUP BY ALL),
    texts AS (
      SELECT f.question, CASE WHEN len(ms) = 0 THEN '{NO_MENTION}'
        WHEN f.item_a IS NULL THEN 'Product ''' || ms[1] || ''' not found'
        WHEN len(ms) > 1 AND f.item_b IS NULL THEN 'Product ''' || ms[2] || ''' not found'
        ELSE CASE WHEN len(ms) > 1 THEN 'Customers who bought both ''' || ms[1] || ''' AND ''' || ms[2] || ''''
               ELSE 'Customers who bought ''' || ms[1] || '''' END || w || ':' || chr(10) ||
          CASE WHEN coalesce(n, 0) > 0 THEN 'Found ' || n || ' customers:' || chr(10) || body ||
                 CASE WHEN n > 10 THEN chr(10) || '... and ' || (n - 10) || ' more customers' ELSE '' END
               WHEN len(ms) > 1 THEN 'No customers found who purchased both products' || w || '.' || chr(10) || 'Note:'
                 || chr(10) || '  • ' || coalesce(n_a, 0) || ' customers bought ''' || ms[1] || '''' || w
                 || chr(10) || '  • ' || coalesce(n_b, 0) || ' customers bought ''' || ms[2] || '''' || w
               ELSE 'No customers found who purchased this product' || w || '.' END END AS answer
      FROM f LEFT JOIN counts c ON {_equal("f", "c", *_RELATION)} LEFT JOIN lists l ON {_equal("f", "l", *_RELATION)})
    SELECT question_id, answer FROM questions JOIN texts USING (question)"""),
)
def j1_dated_pairs(r):
    log = question_log(r).select("question_id", "question")
    return answer_relations(log, r.sales("item_id", "customer_id", "sale_date"), r.items(), r.customers())


@book.star(
    "j4_result_diff",
    """
    , id AS (SELECT customer_id, round(sum(total_sales_value), 2) AS v, count(*) AS n FROM sales GROUP BY 1),
    e AS (SELECT customer_name, v FROM id JOIN customers USING (customer_id)),
    w AS (SELECT customer_name, round(sum(total_sales_value), 2) AS v FROM sales JOIN items USING (item_id)
          JOIN customers USING (customer_id) WHERE item_name <> 'red plate' GROUP BY 1),
    d AS (SELECT *, 'a' AS only_in FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM w)
          UNION ALL SELECT *, 'b' FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM e))
    SELECT customer_name, v, only_in, count(*) AS copies FROM d GROUP BY ALL""",
)
def j4(r):
    by_id = agg.top_n(r.sales("customer_id", V), r.customers(), "customer_id", "customer_name", V, n=None)
    fact = r.sales("item_id", "customer_id", V)
    wide = denormalize(fact, [(r.items(), "item_id", "item_id"), (r.customers(), "customer_id", "customer_id")])
    by_name = agg.top_n_denormalized(wide.filter("item_name <> 'red plate'"), "customer_name", V, n=None)
    a = by_id.select("customer_name", F.round(V, 2).alias("v"))
    b = by_name.select("customer_name", F.round(V, 2).alias("v"))
    return ev.result_diff(a, b)


@book.star(
    "j4_same_result_two_ways",
    "SELECT CAST(0 AS BIGINT) AS differing_rows, count(DISTINCT customer_id) AS compared FROM sales",
)
def j4_same(r):
    by_id = agg.top_n(r.sales("customer_id", V), r.customers(), "customer_id", "customer_name", V, n=None)
    fact = r.sales("item_id", "customer_id", V)
    wide = denormalize(fact, [(r.items(), "item_id", "item_id"), (r.customers(), "customer_id", "customer_id")])
    by_name = agg.top_n_denormalized(wide, "customer_name", V, n=None)
    a = by_id.select("customer_name", F.round(V, 2).alias("v"))
    b = by_name.select("customer_name", F.round(V, 2).alias("v"))
    return ev.result_diff(a, b).agg(F.count(F.lit(1)).alias("differing_rows")).select(
        "differing_rows", a.agg(F.count(F.lit(1))).scalar().alias("compared")
    )
