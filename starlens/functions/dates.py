"""Date predicates that reach the scan.  (E4, E5)"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _as_date(value: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def _next_month(day: dt.date, months: int) -> dt.date:
    index = day.year * 12 + day.month - 1 + months
    return dt.date(index // 12, index % 12 + 1, 1)


def _half_open(col: Column, start: dt.date, stop: dt.date) -> Column:
    return (col >= F.lit(start)) & (col < F.lit(stop))


def date_predicate(
    col: str | Column,
    year: int | None = None,
    month: int | None = None,
    quarter: int | None = None,
) -> Column:
    """Year, month and quarter filters in any combination, all of which must hold.

    A year (with its month or quarter) becomes a half-open range, which parquet statistics and
    partition pruning can use; ``year(col) = y`` would only push a null check.
    """
    col = F.col(col) if isinstance(col, str) else col
    if year is None:
        clauses = []
        if month is not None:
            clauses.append(F.month(col) == month)
        if quarter is not None:
            clauses.append(F.quarter(col) == quarter)
        if not clauses:
            return F.lit(True)
        return clauses[0] if len(clauses) == 1 else clauses[0] & clauses[1]
    if month is not None:
        if quarter is not None and (month - 1) // 3 + 1 != quarter:
            return F.lit(False)
        start, span = dt.date(year, month, 1), 1
    elif quarter is not None:
        start, span = dt.date(year, 3 * quarter - 2, 1), 3
    else:
        start, span = dt.date(year, 1, 1), 12
    return _half_open(col, start, _next_month(start, span))


def date_between(df: DataFrame, col: str, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """E5: rows dated from ``start`` to ``end``, both days included (also for timestamps)."""
    stop = _as_date(end) + dt.timedelta(days=1)
    return df.filter(_half_open(F.col(col), _as_date(start), stop))
