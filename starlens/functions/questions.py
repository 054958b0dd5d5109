"""Question classification as column expressions over a table of questions.  (D1-D11)

Everything is built-in string and regex work on one column, so classifying a log is a narrow pass
without Python.  "Compat" notes name the choices that keep a rule as users of keyword routing know
it; ``strict=True`` asks for the repaired rule.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.config import RETAIL, StarConfig

# The keyword lists of the classifier.
AGGREGATION_WORDS = (
    "top", "bottom", "highest", "lowest", "most", "least", "best", "worst", "maximum", "minimum", "largest", "smallest",
)
MEASURE_WORDS = {
    "sales": "total_sales_value",
    "revenue": "total_sales_value",
    "value": "total_sales_value",
    "amount": "total_sales_value",
    "units": "units_sold",
    "quantity": "units_sold",
    "items": "units_sold",
    "purchases": "COUNT(*)",
    "orders": "COUNT(*)",
    "transactions": "COUNT(*)",
    "count": "COUNT(*)",
}
BOTTOM_WORDS = ("bottom", "worst", "least", "lowest", "minimum")
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
COMPLEX_PHRASES = (
    "average", "mean", "median", "variance", "std", "deviation",
    "above-average", "below-average", "above average", "below average",
    "more than", "less than", "greater than", "higher than", "lower than", "compared to", "versus", "vs",
    "at least", "at most", "only", "exclusively", "all three", "all locations", "every location", "each location",
    "percentage", "percent", "contribution", "proportion", "ratio", "per unit", "per customer", "per item",
    "growth", "change", "difference",
    "high-value", "low-value", "valuable", "most valuable", "lifetime value", "customer value", "total value",
    "best", "worst", "highest", "lowest", "calculate", "compute", "determine", "find out",
    "month-over-month", "year-over-year", "trend", "over time", "between purchases", "frequency", "interval",
    "together", "along with", "combination", "such that", "that are", "that have", "with the", "having",
    "high-income", "low-income", "wealthy", "affluent",
)
CUSTOMER_VALUE_WORDS = (
    "value", "worth", "valuable", "spend", "spent", "spending", "revenue", "sales", "purchase", "bought",
)
PATTERN_PHRASES = (
    "also bought", "also purchased", "which customers bought", "which customers purchased", "customers who bought",
)
NOT_PRODUCTS = ("which", "customers", "product", "item", "bought", "purchased", "also", "during", "in")
COMMAND_WORDS = ("find", "show", "list", "what", "who", "give", "calculate", "top", "bottom")

SIMPLE_AGGREGATION_WORDS = (
    "top", "highest", "most", "best", "total", "sum", "average", "max", "min", "count", "bottom", "worst", "list",
)
SIMPLE_MEASURE_WORDS = {
    "sales": "total_sales_value",
    "revenue": "total_sales_value",
    "units": "units_sold",
    "quantity": "units_sold",
    "volume": "units_sold",
    "transactions": "COUNT(*)",
}
SIMPLE_ENTITY_WORDS = {
    "item_details": ("item", "product", "goods"),
    "store_location": ("location", "store", "place", "shop"),
}


def _text(question: str | Column) -> Column:
    return F.col(question) if isinstance(question, str) else question


def mentions_any(lowered: Column, words: Sequence[str]) -> Column:
    """Substring test against a word list.

    A word that contains another listed word adds nothing and is left out.  The list stays one
    constant array, so the compiled projection does not grow with it, and the outer ``exists``
    evaluates the text once.
    """
    needed = [w for w in words if not any(v != w and v in w for v in words)]
    listed = F.array(*[F.lit(w) for w in needed])
    return F.exists(F.array(lowered), lambda q: F.exists(listed, lambda w: q.contains(w)))


def first_of(lowered: Column, mapping: Mapping[str, str]) -> Column:
    """Value of the first keyword, in mapping order, that occurs in the text."""
    return F.coalesce(*[F.when(lowered.contains(k), F.lit(v)) for k, v in mapping.items()])


def is_complex(question: str | Column) -> Column:
    """A phrase of deeper analysis, or customer value without a plain "top"/"bottom" request."""
    q = F.lower(_text(question))
    ranked = mentions_any(q, ("top ", "bottom "))
    value = q.contains("customer") & mentions_any(q, CUSTOMER_VALUE_WORDS) & ~ranked
    return value | mentions_any(q, COMPLEX_PHRASES)


def is_aggregation(question: str | Column) -> Column:
    """Any aggregation word as a substring, or a complex question."""
    q = _text(question)
    return mentions_any(F.lower(q), AGGREGATION_WORDS) | is_complex(q)


def measure(question: str | Column) -> Column:
    """Measure of the first keyword in mapping order (``items`` means units)."""
    return first_of(F.lower(_text(question)), MEASURE_WORDS)


def entity_type(question: str | Column, config: StarConfig = RETAIL) -> Column:
    """D3: first configured dimension one of whose words occurs."""
    q = F.lower(_text(question))
    return F.coalesce(*[F.when(mentions_any(q, e.synonyms), F.lit(e.table)) for e in config.entities])


def first_number(question: str | Column, default: int = 5) -> Column:
    """D4 limit, compat: the first standalone number anywhere, a year included; null if it exceeds a bigint."""
    found = F.regexp_extract(_text(question), r"\b(\d+)\b", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit(default).cast("bigint")).otherwise(found.try_cast("bigint"))


def is_bottom(question: str | Column) -> Column:
    """D4 direction; "at least" counts as bottom (compat)."""
    return mentions_any(F.lower(_text(question)), BOTTOM_WORDS)


def _int(text: Column) -> Column:
    return F.nullif(text, F.lit("")).cast("bigint")


def year_of(question: str | Column) -> Column:
    return _int(F.regexp_extract(_text(question), r"\b(20\d{2})\b", 1))


def month_of(question: str | Column, strict: bool = False) -> Column:
    """Month by name or abbreviation, earliest month first.

    Compat: any occurrence, so "declining" is December.  Strict: whole words only.
    """
    q = F.lower(_text(question))
    cases = []
    for number, name in enumerate(MONTH_NAMES, 1):
        if strict:
            extra = "|sept" if name == "september" else ""
            hit = q.rlike(rf"\b({name}|{name[:3]}{extra})\b")
        else:
            hit = q.contains(name[:3])
        cases.append(F.when(hit, F.lit(number).cast("bigint")))
    return F.coalesce(*cases)


def quarter_of(question: str | Column) -> Column:
    return _int(F.regexp_extract(F.lower(_text(question)), r"\bq([1-4])\b", 1))


def is_pattern(question: str | Column) -> Column:
    return mentions_any(F.lower(_text(question)), PATTERN_PHRASES)


def route(question: str | Column, config: StarConfig = RETAIL) -> Column:
    """Pattern, then simple aggregation, then complex aggregation, else semantic."""
    q = _text(question)
    ranked = mentions_any(F.lower(q), AGGREGATION_WORDS)
    hard = is_complex(q)
    return (
        F.when(is_pattern(q), F.lit("pattern"))
        .when(ranked & measure(q).isNotNull() & entity_type(q, config).isNotNull() & ~hard, F.lit("simple"))
        .when(ranked | hard, F.lit("complex"))
        .otherwise(F.lit("semantic"))
    )


def deployed_route(question: str | Column) -> Column:
    """The served form: aggregation words first, then patterns, no complex class."""
    q = _text(question)
    return (
        F.when(mentions_any(F.lower(q), AGGREGATION_WORDS), F.lit("aggregation"))
        .when(is_pattern(q), F.lit("pattern"))
        .otherwise(F.lit("semantic"))
    )


def product_mentions(question: str | Column, capitalised: bool = True, strict: bool = True) -> Column:
    """Quoted texts; else ids like ``p-20``; else capitalised phrases minus known words.

    Strict: a text ends at the quote mark it began with, and month names and commands are not
    products.  Compat: any quote mark ends a text.  ``capitalised=False`` leaves out the last step.
    """
    q = _text(question)
    if strict:
        raw = F.regexp_extract_all(q, F.lit(r"""("[^"]+"|(?:^|\s)'[^']+')"""), F.lit(1))
        quoted = F.transform(raw, lambda m: F.regexp_replace(m, r"""^\s*["']|["']$""", ""))
    else:
        quoted = F.regexp_extract_all(q, F.lit("""["']([^"']+)["']"""), F.lit(1))
    ids = F.regexp_extract_all(q, F.lit(r"(?i)\b([a-z]-\d+)\b"), F.lit(1))
    empty = F.array().cast("array<string>")
    if capitalised:
        phrases = F.regexp_extract_all(q, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), F.lit(1))
        dropped = NOT_PRODUCTS + (COMMAND_WORDS + MONTH_NAMES if strict else ())
        last = F.filter(phrases, lambda p: ~F.lower(p).isin(*dropped))
    else:
        last = empty
    return F.when(F.size(quoted) > 0, quoted).when(F.size(ids) > 0, ids).otherwise(last)


# -- the simpler classifier ------------------------------------------------------------------------


def ranked_limit(question: str | Column, default: int = 5) -> Column:
    """The number in "top N" or "N top/best/highest" only; null if it exceeds a bigint."""
    q = F.lower(_text(question))
    match = r"top (\d+)|(\d+) (?:top|best|highest)"
    found = F.concat(F.regexp_extract(q, match, 1), F.regexp_extract(q, match, 2))
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit(default).cast("bigint")).otherwise(found.try_cast("bigint"))


def simple_date_filters(question: str | Column, as_of: str | dt.date) -> dict[str, Column]:
    """Month name, else ``month 12`` or ``12/2025``; year; quarter; this/last month or year.

    Relative dates count from ``as_of``, a parameter, so a rerun gives the same rows.
    """
    q = F.lower(_text(question))
    day = dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    numeric = F.concat(
        F.regexp_extract(q, r"\bmonth\s+(\d{1,2})\b", 1),
        F.when(
            F.regexp_extract(q, r"\bmonth\s+(\d{1,2})\b", 1) == "", F.regexp_extract(q, r"\b(\d{1,2})[/\-]", 1)
        ).otherwise(""),
    )
    number = _int(numeric)
    month = F.coalesce(month_of(q), F.when(number.between(1, 12), number))
    last_month = (day.year, day.month - 1) if day.month > 1 else (day.year - 1, 12)

    def const(n: int) -> Column:
        return F.lit(n).cast("bigint")

    def relative(previous: Column, this_month, before, this_year=None, last_year=None) -> Column:
        out = F.when(q.contains("last month"), const(before)).when(q.contains("this month"), const(this_month))
        if this_year is not None:
            out = out.when(q.contains("last year"), const(last_year)).when(q.contains("this year"), const(this_year))
        return out.otherwise(previous)

    return {
        "year": relative(year_of(_text(question)), day.year, last_month[0], day.year, day.year - 1),
        "month": relative(month, day.month, last_month[1]),
        "quarter": quarter_of(q),
    }


def simple_intent(question: str | Column, as_of: str | dt.date) -> dict[str, Column]:
    """All fields of the simpler classifier; measure and entity have defaults."""
    q = F.lower(_text(question))
    aggregates = mentions_any(q, SIMPLE_AGGREGATION_WORDS)
    entity = F.coalesce(
        *[F.when(mentions_any(q, words), F.lit(table)) for table, words in SIMPLE_ENTITY_WORDS.items()]
    )
    return {
        "is_aggregation": aggregates,
        "measure": F.coalesce(first_of(q, SIMPLE_MEASURE_WORDS), F.when(aggregates, F.lit("total_sales_value"))),
        "entity_type": F.coalesce(entity, F.when(aggregates, F.lit("item_details"))),
        "limit": ranked_limit(question),
        **simple_date_filters(question, as_of),
    }


def classify(questions: DataFrame, question: str = "question", config: StarConfig = RETAIL, strict: bool = False) -> DataFrame:
    """All intent columns beside the question."""
    q = F.col(question)
    return questions.withColumns(
        {
            "is_aggregation": is_aggregation(q),
            "is_complex": is_complex(q),
            "measure": measure(q),
            "entity_type": entity_type(q, config),
            "limit": ranked_limit(q) if strict else first_number(q),
            "is_bottom": is_bottom(q),
            "year": year_of(q),
            "month": month_of(q, strict),
            "quarter": quarter_of(q),
            "route": route(q, config),
            "deployed_route": deployed_route(q),
        }
    )


# -- answers of text-to-SQL models -----------------------------------------------------------------


def extract_sql(response: str | Column) -> Column:
    """Code fences removed, then everything from the first line that starts a statement."""
    bare = F.regexp_replace(F.regexp_replace(_text(response), r"```sql\s*", ""), r"```\s*", "")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    return F.regexp_extract(bare, r"(?ims)^[ \t]*(?:SELECT|WITH|INSERT|UPDATE|DELETE).*", 0)
