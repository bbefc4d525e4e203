"""Month arithmetic.

Column helpers work on ``date`` columns; the plain-Python helpers work on
report parameters only (never on data) and fold into literals.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

HISTORICAL = "Historical"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit_date(d) -> Column:
    return d if isinstance(d, Column) else F.lit(d)


def month_start(c) -> Column:
    """First day of the month as a ``date`` (no time zone involved)."""
    return F.trunc(F.to_date(_col(c)), "MM")


def add_months(d: date, n: int) -> date:
    """Parameter arithmetic: ``d`` moved by ``n`` months, day clamped."""
    idx = d.year * 12 + (d.month - 1) + n
    y, m = divmod(idx, 12)
    m += 1
    if m == 12:
        last = 31
    else:
        last = (date(y, m + 1, 1) - date(y, m, 1)).days
    return date(y, m, min(d.day, last))


def first_month_on_or_after(d: date) -> date:
    """Smallest first-of-month ``m`` with ``m >= d``."""
    return d if d.day == 1 else add_months(date(d.year, d.month, 1), 1)


def first_month_after(d: date) -> date:
    """First day of the month after ``d``'s month."""
    return add_months(date(d.year, d.month, 1), 1)


def months_since(month, start) -> Column:
    """Whole months from ``start``'s month to ``month``'s month (integer math)."""
    m = _col(month)
    s = _lit_date(start)
    return (F.year(m) - F.year(s)) * 12 + (F.month(m) - F.month(s))


def month_ordinal(month) -> Column:
    """Months counted from year 0, so neighbours differ by one."""
    m = _col(month)
    return F.year(m) * 12 + F.month(m)


def year_number(month, start) -> Column:
    """1 for the first 12 months from ``start``'s month, 2 for the next 12, ..."""
    return (F.floor(months_since(month, start) / F.lit(12)) + 1).cast("int")


def year_bucket(month, start) -> Column:
    """``Historical`` before ``start`` (raw date), else ``Yr<n>``."""
    m = _col(month)
    return (F.when(m < _lit_date(start), F.lit(HISTORICAL))
            .otherwise(F.concat(F.lit("Yr"), year_number(m, start).cast("string"))))


def month_sequence(start, end) -> Column:
    """Months from ``start``'s month to ``end``'s month, inclusive, as an array.

    A reversed range gives an empty array instead of Spark's
    "illegal sequence boundaries" error; works on literals and on columns.
    """
    s = F.trunc(_lit_date(start), "MM")
    e = F.trunc(_lit_date(end), "MM")
    return (F.when(s <= e, F.sequence(s, e, F.expr("INTERVAL 1 MONTH")))
            .otherwise(F.array().cast("array<date>")))
