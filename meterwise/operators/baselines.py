"""Baselines (P4): the usage level a scenario projects from.

Two modes, both for one account or for every account in one pass:

* trailing: sum of ``dollars`` from the first day of the month before the end
  month up to the end date (up to two months), ``default`` when no row.
* latest month: total of the latest month with usage in ``start..end``;
  a total of 0, or no usage at all, becomes the placeholder 1. (The original
  took the latest month of a row-capped fetch; here every row counts.)

The all-accounts forms must not lose an account that has no usage in the
window. With a narrow account list (``accounts``; ``plans.facts`` writes one
beside the usage table) only the window is read: the date filter prunes the
usage table's month folders, and the sums are joined to the list. Without a
list, one pass over the usage table finds the accounts and sums the window
conditionally. With a month summary as well (``months``), the latest-month form
reads it from the newest month backwards (``operators.latest_month``). Either way the sums are partial + final aggregations on the
account key (a hot account contributes one partial row per task).
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions.dates import add_months, month_start
from meterwise.operators.filters import for_account, in_date_range
from meterwise.operators.latest_month import latest_totals
from meterwise.params import LATEST_MONTH_ZERO_PLACEHOLDER

NAME = "baseline_dollars"


def trailing_start(end: date) -> date:
    """First day of the month before ``end``'s month."""
    return add_months(date(end.year, end.month, 1), -1)


def _inside(date_col: str, start: date, end: date) -> Column:
    return F.col(date_col).between(F.lit(start), F.lit(end))


def _for_every(accounts: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return accounts.select(key).distinct().join(found, key, "left")


def trailing_baseline(usage: DataFrame, end: date, default: Decimal, account_id=None,
                      all_accounts: bool = False, accounts: DataFrame | None = None,
                      date_col: str = "usage_date", value: str = "dollars",
                      key: str = "account_id") -> DataFrame:
    """One row ``(baseline_dollars)`` for ``account_id``, or
    ``(account_id, baseline_dollars)`` per account when ``all_accounts``."""
    lo = trailing_start(end)
    fallback = F.lit(Decimal(default))
    if all_accounts and accounts is None:
        return usage.groupBy(key).agg(
            F.coalesce(F.sum(F.when(_inside(date_col, lo, end), F.col(value))), fallback).alias(NAME))
    rows = in_date_range(for_account(usage, None if all_accounts else account_id, key), lo, end, date_col)
    if not all_accounts:
        return rows.agg(F.coalesce(F.sum(value), fallback).alias(NAME))
    sums = rows.groupBy(key).agg(F.sum(value).alias("_total"))
    return _for_every(accounts, sums, key).select(key, F.coalesce("_total", fallback).alias(NAME))


def latest_month_baseline(usage: DataFrame, start: date, end: date, account_id=None,
                          all_accounts: bool = False, accounts: DataFrame | None = None,
                          placeholder: Decimal = LATEST_MONTH_ZERO_PLACEHOLDER,
                          date_col: str = "usage_date", value: str = "dollars",
                          key: str = "account_id", months: DataFrame | None = None) -> DataFrame:
    """Total of the latest month with usage in ``start..end`` (0 -> placeholder)."""
    ph = F.lit(Decimal(placeholder))

    def settle(total: Column) -> Column:
        return F.when(total.isNull() | (total == 0), ph).otherwise(total)

    if all_accounts and accounts is not None and months is not None:
        latest = _for_every(accounts, latest_totals(usage, months, accounts, start, end, key), key)
        return latest.select(key, settle(F.col("_latest")).alias(NAME))
    if all_accounts and accounts is None:
        # Out-of-window rows keep their account (month NULL) so that every
        # account appears; max_by ignores the NULL month.
        month = F.when(_inside(date_col, start, end), month_start(date_col))
        monthly = (usage.select(F.col(key), month.alias("_month"), F.col(value))
                   .groupBy(key, "_month").agg(F.sum(value).alias("_total")))
        return monthly.groupBy(key).agg(settle(F.max_by("_total", "_month")).alias(NAME))
    rows = in_date_range(for_account(usage, None if all_accounts else account_id, key), start, end, date_col)
    by = [key] if all_accounts else []
    monthly = (rows.groupBy(*by, month_start(date_col).alias("_month"))
               .agg(F.sum(value).alias("_total")))
    latest = monthly.groupBy(*by).agg(F.max_by("_total", "_month").alias("_latest"))
    if all_accounts:
        latest = _for_every(accounts, latest, key)
    return latest.select(*by, settle(F.col("_latest")).alias(NAME))
