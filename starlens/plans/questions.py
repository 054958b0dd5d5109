"""D*: classification of the question log."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.functions import questions as qs
from starlens.operators import evaluate as ev
from starlens.plans.book import Book
from starlens.plans.log import QUESTIONS, RESPONSE_LOG, question_log, response_log

book = Book()
AS_OF = "2001-01-15"


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(question), '{w}')" for w in words) + ")"


def _first(mapping) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(question), '{k}') THEN '{v}'" for k, v in mapping.items()) + " END"


_MONTH = "CASE " + " ".join(
    f"WHEN contains(lower(question), '{m[:3]}') THEN {i}" for i, m in enumerate(qs.MONTH_NAMES, 1)
) + " END"
_MONTH_WORD = "CASE " + " ".join(
    rf"WHEN regexp_matches(lower(question), '\b({m}|{m[:3]}{'|sept' if i == 9 else ''})\b') THEN {i}"
    for i, m in enumerate(qs.MONTH_NAMES, 1)
) + " END"
_ENTITY = (
    f"CASE WHEN {_any(('item', 'product', 'sku'))} THEN 'item_details' "
    f"WHEN {_any(('location', 'store', 'place'))} THEN 'store_location' "
    f"WHEN {_any(('customer', 'client', 'buyer'))} THEN 'customer_details' END"
)
_COMPLEX = (
    f"({_any(qs.COMPLEX_PHRASES)} OR (contains(lower(question), 'customer') AND {_any(qs.CUSTOMER_VALUE_WORDS)} "
    f"AND NOT {_any(('top ', 'bottom '))}))"
)
_WORDY = _any(qs.AGGREGATION_WORDS)
_NUMBER = r"CAST(coalesce(nullif(regexp_extract(question, '\b(\d+)\b', 1), ''), '5') AS BIGINT)"
_YEAR = r"CAST(nullif(regexp_extract(question, '\b(20\d{2})\b', 1), '') AS BIGINT)"
_QUARTER = r"CAST(nullif(regexp_extract(lower(question), '\bq([1-4])\b', 1), '') AS BIGINT)"

INTENT = f"""{QUESTIONS},
intent AS (
  SELECT *, {_WORDY} OR {_COMPLEX} AS is_aggregation, {_COMPLEX} AS is_complex, {_first(qs.MEASURE_WORDS)} AS measure,
    {_ENTITY} AS entity_type, {_any(qs.PATTERN_PHRASES)} AS is_pattern FROM questions),
routed AS (
  SELECT *, CASE WHEN is_pattern THEN 'pattern'
                 WHEN NOT is_complex AND is_aggregation AND measure IS NOT NULL AND entity_type IS NOT NULL THEN 'simple'
                 WHEN is_aggregation THEN 'complex' ELSE 'semantic' END AS route FROM intent)"""


def _register(name, body):
    return book.query(name, f"WITH {INTENT}\n{body}")


def _log(r):
    return question_log(r).select("question_id", "question")


@_register("d1_is_aggregation", "SELECT question_id, is_aggregation FROM intent")
def d1(r):
    return _log(r).select("question_id", qs.is_aggregation("question").alias("is_aggregation"))


@_register("d2_measure", "SELECT question_id, coalesce(measure, '') AS measure FROM intent")
def d2(r):
    return _log(r).select("question_id", F.coalesce(qs.measure("question"), F.lit("")).alias("measure"))


@_register("d3_entity_type", "SELECT question_id, coalesce(entity_type, '') AS entity_type FROM intent")
def d3(r):
    return _log(r).select("question_id", F.coalesce(qs.entity_type("question"), F.lit("")).alias("entity_type"))


@_register("d4_limit", f'SELECT question_id, {_NUMBER} AS "limit", {_any(qs.BOTTOM_WORDS)} AS is_bottom FROM questions')
def d4(r):
    return _log(r).select(
        "question_id", qs.first_number("question").alias("limit"), qs.is_bottom("question").alias("is_bottom")
    )


@_register(
    "d5_date_filters",
    f"""SELECT question_id, coalesce({_YEAR}, -1) AS year, CAST(coalesce({_MONTH}, -1) AS BIGINT) AS month,
    CAST(coalesce({_MONTH_WORD}, -1) AS BIGINT) AS month_word, coalesce({_QUARTER}, -1) AS quarter FROM questions""",
)
def d5(r):
    fields = {
        "year": qs.year_of("question"),
        "month": qs.month_of("question"),
        "month_word": qs.month_of("question", strict=True),
        "quarter": qs.quarter_of("question"),
    }
    return _log(r).select(
        "question_id", *[F.coalesce(c, F.lit(-1).cast("bigint")).alias(n) for n, c in fields.items()]
    )


@_register("d6_is_complex", "SELECT question_id, is_complex FROM intent")
def d6(r):
    return _log(r).select("question_id", qs.is_complex("question").alias("is_complex"))


@_register("d7_route", "SELECT question_id, route FROM routed")
def d7(r):
    return _log(r).select("question_id", qs.route("question").alias("route"))


_QUOTED = r"""list_transform(regexp_extract_all(question, '("[^"]+"|(?:^|\s)''[^'']+'')', 1),
    lambda m: regexp_replace(regexp_replace(m, '^\s*["'']', ''), '["'']$', ''))"""
_IDS = r"regexp_extract_all(question, '(?i)\b([a-z]-\d+)\b', 1)"
_DROPPED = ", ".join(f"'{w}'" for w in qs.NOT_PRODUCTS + qs.COMMAND_WORDS + qs.MONTH_NAMES)
_CAPS = rf"""list_filter(regexp_extract_all(question, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b', 1),
    lambda p: lower(p) NOT IN ({_DROPPED}))"""


@book.query(
    "d8_product_mentions",
    f"""WITH {QUESTIONS},
    m AS (SELECT question_id, CASE WHEN len({_QUOTED}) > 0 THEN {_QUOTED} WHEN len({_IDS}) > 0 THEN {_IDS} ELSE {_CAPS} END AS ms
          FROM questions WHERE {_any(qs.PATTERN_PHRASES)})
    SELECT question_id, array_to_string(ms, ' ; ') AS mentions, CAST(len(ms) AS BIGINT) AS n FROM m""",
)
def d8(r):
    asked = _log(r).filter(qs.is_pattern("question"))
    found = asked.select("question_id", qs.product_mentions("question").alias("m"))
    return found.select(
        "question_id", F.array_join("m", " ; ").alias("mentions"), F.size("m").cast("bigint").alias("n")
    )


_SIMPLE_AGG = _any(qs.SIMPLE_AGGREGATION_WORDS)
_SIMPLE_ENTITY = "CASE " + " ".join(f"WHEN {_any(w)} THEN '{t}'" for t, w in qs.SIMPLE_ENTITY_WORDS.items()) + " END"
_NUMERIC_MONTH = r"""CAST(nullif(CASE WHEN regexp_extract(lower(question), '\bmonth\s+(\d{1,2})\b', 1) <> ''
    THEN regexp_extract(lower(question), '\bmonth\s+(\d{1,2})\b', 1)
    ELSE regexp_extract(lower(question), '\b(\d{1,2})[/\-]', 1) END, '') AS BIGINT)"""
_TOPN = r"top (\d+)|(\d+) (?:top|best|highest)"


@book.query(
    "d9_simple_intent",
    f"""WITH {QUESTIONS},
    base AS (SELECT question_id, lower(question) AS l, {_SIMPLE_AGG} AS is_aggregation,
      {_first(qs.SIMPLE_MEASURE_WORDS)} AS m, {_SIMPLE_ENTITY} AS e,
      regexp_extract(lower(question), '{_TOPN}', 1) || regexp_extract(lower(question), '{_TOPN}', 2) AS lim,
      {_YEAR} AS y, {_QUARTER} AS q, coalesce({_MONTH}, CASE WHEN {_NUMERIC_MONTH} BETWEEN 1 AND 12 THEN {_NUMERIC_MONTH} END) AS mon
      FROM questions)
    SELECT question_id, is_aggregation, coalesce(m, CASE WHEN is_aggregation THEN 'total_sales_value' END, '') AS measure,
      coalesce(e, CASE WHEN is_aggregation THEN 'item_details' END, '') AS entity_type,
      CAST(coalesce(nullif(lim, ''), '5') AS BIGINT) AS "limit",
      CAST(coalesce(CASE WHEN contains(l, 'last month') THEN 2000 WHEN contains(l, 'this month') THEN 2001
           WHEN contains(l, 'last year') THEN 2000 WHEN contains(l, 'this year') THEN 2001 ELSE y END, -1) AS BIGINT) AS year,
      CAST(coalesce(CASE WHEN contains(l, 'last month') THEN 12 WHEN contains(l, 'this month') THEN 1 ELSE mon END, -1) AS BIGINT) AS month,
      coalesce(q, -1) AS quarter FROM base""",
)
def d9(r):
    fields = qs.simple_intent("question", AS_OF)
    out = _log(r).select("question_id", *[c.alias(n) for n, c in fields.items()])
    return out.fillna("", ["measure", "entity_type"]).fillna(-1, ["year", "month", "quarter"])


@_register(
    "d10_deployed_route",
    f"""SELECT question_id, CASE WHEN {_WORDY} THEN 'aggregation' WHEN is_pattern THEN 'pattern'
    ELSE 'semantic' END AS route FROM intent""",
)
def d10(r):
    return _log(r).select("question_id", qs.deployed_route("question").alias("route"))


@book.query(
    "d11_extract_sql",
    rf"""WITH {RESPONSE_LOG},
    bare AS (SELECT response_id, regexp_replace(regexp_replace(regexp_replace(response, '```sql\s*', '', 'g'),
      '```\s*', '', 'g'), '^\s+|\s+$', '', 'g') AS t FROM responses)
    SELECT response_id, regexp_extract(t, '(?ims)^[ \t]*(?:SELECT|WITH|INSERT|UPDATE|DELETE).*', 0) AS sql FROM bare""",
)
def d11(r):
    return response_log(r).select("response_id", qs.extract_sql("response").alias("sql"))


@_register(
    "d12_route_summary",
    """SELECT route, count(*) AS questions, round(100.0 * count(*) / (SELECT count(*) FROM routed), 6) AS share_pct
    FROM routed GROUP BY route""",
)
def d12(r):
    out = ev.route_summary(_log(r).select(qs.route("question").alias("route")))
    return out.withColumn("share_pct", F.round("share_pct", 6))


@_register(
    "j2_route_confusion",
    """SELECT expected, route, count(*) AS questions, expected = route AS agrees FROM routed GROUP BY ALL""",
)
def j2(r):
    return ev.route_confusion(question_log(r).withColumn("route", qs.route("question")))


@book.query(
    "j3_success_rate",
    f"""WITH {RESPONSE_LOG},
    f AS (SELECT contains(lower(response), 'error') OR contains(lower(response), 'cannot') AS failed FROM responses)
    SELECT count(*) AS answers, count(*) FILTER (NOT failed) AS successes,
           round(100.0 * count(*) FILTER (NOT failed) / count(*), 6) AS success_pct FROM f""",
)
def j3(r):
    out = ev.success_rate(response_log(r), "response")
    return out.withColumn("success_pct", F.round("success_pct", 6))
