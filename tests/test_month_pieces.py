"""Months of sales are added up after they are dealt into pieces, and no sum is held before."""

import datetime
from collections import Counter

from starlens.config import RETAIL
from starlens.operators.answers import monthly_totals


def _fact(spark, n):
    day = datetime.date(2001, 1, 30)
    rows = [
        (None if i % 11 == 0 else i % 5, i % 3, i % 4, None if i % 13 == 0 else day + datetime.timedelta(days=i % 400), 1.0 * (i % 6), 0.5 * i)
        for i in range(n)
    ]
    names = "item_id long, location_id long, customer_id long, sale_date date, units_sold double, total_sales_value double"
    return rows, spark.createDataFrame(rows, names)


def test_months_are_added_up_after_the_shuffle(spark, tmp_path):
    _fact(spark, 60)[1].write.parquet(str(tmp_path / "fact"))
    plan = monthly_totals(spark.read.parquet(str(tmp_path / "fact")))._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    sums = [i for i, line in enumerate(plan) if "HashAggregate" in line]
    assert len(exchanges) == 1 and max(sums) < exchanges[0]


def test_months_of_all_dimensions(spark):
    rows, fact = _fact(spark, 500)
    expected, n = Counter(), Counter()
    for row in rows:
        for e, key in zip(RETAIL.entities, (dict(zip(("item_id", "location_id", "customer_id"), row))[e.fact_key] for e in RETAIL.entities)):
            if key is not None and row[3] is not None:
                at = (e.table, key, row[3].year, row[3].month)
                expected[at] += row[5]
                n[at] += 1
    got = monthly_totals(fact).collect()
    assert len(got) == len(n)
    assert {(r.entity_type, r.key, r.y, r.m): (r.total_sales_value, r.transactions) for r in got} == {k: (expected[k], n[k]) for k in n}
