"""Latest-month baseline from a maintained summary, newest month first.

``plans.facts`` writes, beside the usage lines, one row per account and month
with its total, in a folder per month. An account's baseline is in its newest
month, and most accounts have usage in the last months of a range, so the
summary is read backwards: one month, then the two before it, then four, and so
on, each step only for accounts that no later month has settled. The walk stops
when none is left. The number of steps is the logarithm of the months in range;
a step reads month folders of narrow rows, and nothing but a count per step
reaches the driver.

The account list holds each account's first and last month, so accounts without
a month in the range are never looked for. Only a month that the range cuts is
read from the usage lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.functions.dates import add_months, first_month_after, first_month_on_or_after
from meterwise.operators.filters import in_date_range
from meterwise.sources.staging import staged, staged_counted


def month_totals(usage: DataFrame, date_col: str = "usage_date", value: str = "dollars",
                 key: str = "account_id") -> DataFrame:
    """(key, month, total, lines) of every account and month with usage."""
    return usage.groupBy(key, F.trunc(date_col, "MM").alias("month")).agg(
        F.sum(value).cast("decimal(28,4)").alias("total"), F.count(F.lit(1)).alias("lines"))


def _steps(start: date, end: date) -> Iterator[tuple[date, date, bool]]:
    """Ranges of days from ``end`` back to ``start``: (first, last, whole
    months?). Whole months come in runs of 1, 2, 4, ...; months that the range
    cuts stand alone."""
    last = end
    if first_month_after(end).toordinal() - 1 != end.toordinal():
        first = max(date(end.year, end.month, 1), start)
        yield first, end, False
        last = date.fromordinal(first.toordinal() - 1)
    whole, n = first_month_on_or_after(start), 1
    while last >= whole:
        first = max(add_months(date(last.year, last.month, 1), 1 - n), whole)
        yield first, last, True
        last, n = date.fromordinal(first.toordinal() - 1), 2 * n
    if last >= start:
        yield start, last, False


def latest_totals(usage: DataFrame, months: DataFrame, accounts: DataFrame, start: date, end: date,
                  key: str = "account_id", seen: list | None = None) -> DataFrame:
    """(key, ``_latest``): each account's total of its latest month with usage
    in ``start..end``, for the accounts that have one. The steps run when this
    is called; ``seen`` collects their (first, last) days."""
    if start > end:
        return accounts.select(key, F.lit(None).cast("decimal(38,4)").alias("_latest")).limit(0)
    first, last = F.trunc(F.lit(start), "MM"), F.trunc(F.lit(end), "MM")
    todo, left = staged_counted(accounts.where((F.col("first_month") <= last) & (F.col("last_month") >= first))
                                .select(key), "accounts-to-settle")
    found = []
    for a, b, whole in _steps(start, end):
        if not left:
            break
        if seen is not None:
            seen.append((a, b))
        if whole:
            rows = in_date_range(months, a, b, "month")
        else:
            rows = month_totals(in_date_range(usage, a, b, "usage_date"), key=key)
        settled = staged(rows.join(todo, key, "left_semi").groupBy(key).agg(
            F.max_by("total", "month").cast("decimal(38,4)").alias("_latest")), "settled")
        found.append(settled)
        todo, left = staged_counted(todo.join(settled, key, "left_anti"), "accounts-to-settle")
    if not found:
        return accounts.select(key, F.lit(None).cast("decimal(38,4)").alias("_latest")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
