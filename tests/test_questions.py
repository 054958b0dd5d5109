"""The literal question corpus with its expected fields, read from FIXTURES.md."""

import os
import re

import pytest
from pyspark.sql import functions as F

from starlens.functions import questions as qs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def corpus():
    rows = []
    with open(os.path.join(ROOT, "FIXTURES.md"), encoding="utf-8") as f:
        for line in f:
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if len(cells) == 12 and re.fullmatch(r"\d+", cells[0]):
                rows.append([None if c == "–" else c for c in cells])
    return rows


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(int(c[0]), c[1]) for c in corpus()]
    df = spark.createDataFrame(rows, "n bigint, question string")
    return {r["n"]: r for r in qs.classify(df).collect()}


def test_corpus_is_complete():
    assert len(corpus()) == 48


@pytest.mark.parametrize("cells", corpus(), ids=lambda c: c[0])
def test_fields(classified, cells):
    n, _, _, _, route, measure, entity, limit, bottom, year, month, quarter = cells
    row = classified[int(n)]

    def number(text):
        return None if text is None else int(text)

    assert row["route"] == route
    if measure is not None:
        assert row["measure"] == measure
    if entity is not None:
        assert row["entity_type"] == entity
    assert row["limit"] == int(limit)
    assert row["is_bottom"] == (bottom == "yes")
    assert (row["year"], row["month"], row["quarter"]) == (number(year), number(month), number(quarter))


def one(spark, text, **columns):
    return spark.createDataFrame([(text,)], "question string").select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(
    "text, strict, expected",
    [
        ('Which customers bought "Cocoa Swirl"?', True, ["Cocoa Swirl"]),
        ("Which customers bought \"S'mores Sensation\" and 'Berry Burst'?", True, ["S'mores Sensation", "Berry Burst"]),
        ("Which customers bought \"S'mores Sensation\"?", False, ["S"]),
        ("Which customers bought p-20 or P-3?", True, ["p-20", "P-3"]),
        ("Find customers who bought Cocoa Swirl in December", True, ["Cocoa Swirl"]),
        ("Find customers who bought Cocoa Swirl in December", False, ["Find", "Cocoa Swirl", "December"]),
        ("which customers bought nothing", True, []),
    ],
)
def test_mentions(spark, text, strict, expected):
    assert one(spark, text, m=qs.product_mentions("question", strict=strict))["m"] == expected


@pytest.mark.parametrize(
    "text, as_of, expected",
    [
        ("Show top items this year", "2025-06-10", (True, "total_sales_value", "item_details", 5, 2025, None, None)),
        ("Show top 5 locations by sales in Q4 2025", "2024-01-01", (True, "total_sales_value", "store_location", 5, 2025, None, 4)),
        ("Top selling items in November 2025", "2024-01-01", (True, "total_sales_value", "item_details", 5, 2025, 11, None)),
        ("Top 7 shops by volume last month", "2025-01-10", (True, "units_sold", "store_location", 7, 2024, 12, None)),
        ("3 best goods by transactions 12/2025", "2025-01-10", (True, "COUNT(*)", "item_details", 3, 2025, 12, None)),
        ("Chocolate", "2025-01-10", (False, None, None, 5, None, None, None)),
    ],
)
def test_simple_intent(spark, text, as_of, expected):
    row = one(spark, text, **qs.simple_intent("question", as_of))
    assert tuple(row) == expected


def test_strict_months(spark):
    assert one(spark, "declining margin, maybe", m=qs.month_of("question"))["m"] == 3
    assert one(spark, "declining margin, maybe", m=qs.month_of("question", strict=True))["m"] is None


@pytest.mark.parametrize(
    "response, sql",
    [
        ("```sql\nSELECT 1\n```", "SELECT 1\n"),
        ("Sure:\n\n  with t as (select 1)\nselect * from t", "  with t as (select 1)\nselect * from t"),
        ("I do not know.", ""),
    ],
)
def test_extract_sql(spark, response, sql):
    got = spark.createDataFrame([(response,)], "r string").select(qs.extract_sql("r").alias("s")).first()["s"]
    assert got.strip() == sql.strip()


def test_null_question(spark):
    df = spark.createDataFrame([(None,)], "question string")
    assert df.select(F.coalesce(qs.route("question"), F.lit("none")).alias("r")).first()["r"] == "semantic"
