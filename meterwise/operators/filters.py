"""Predicates (F1-F5, F9). Each returns a filtered DataFrame."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.schemas import MONTH_PARTITION_OF


def name_matches(df: DataFrame, pattern: str, col: str = "account_name") -> DataFrame:
    """Case-insensitive LIKE (``%``, ``_``). NULL names never match, even ``%``.

    A backslash escapes the next character; one before an ordinary character
    is an error in Spark.
    """
    return df.filter(F.col(col).ilike(pattern))


def in_date_range(df: DataFrame, start: date, end: date, col: str) -> DataFrame:
    """Inclusive ``start <= col <= end`` on a ``date`` column.

    When the frame also carries the month partition column of ``col`` (a
    written usage table), the implied month range is added so the scan
    prunes month folders; it never changes the result.
    """
    cond = (F.col(col) >= F.lit(start)) & (F.col(col) <= F.lit(end))
    part = MONTH_PARTITION_OF.get(col)
    if part and part in df.columns:
        cond = cond & (F.col(part) >= F.trunc(F.lit(start), "MM")) & (F.col(part) <= F.lit(end))
    return df.filter(cond)


def for_account(df: DataFrame, account_id, col: str = "account_id") -> DataFrame:
    """Equality on the account id; ``None`` keeps every account."""
    if account_id is None:
        return df
    return df.filter(F.col(col) == F.lit(account_id))


def positive_amount(df: DataFrame, col: str = "amount") -> DataFrame:
    """Rows with ``col > 0``; applied *after* the previous-month window."""
    return df.filter(F.col(col) > 0)


def keep_growth_at_least(df: DataFrame, minimum: float | None,
                         col: str = "mom_growth_pct") -> DataFrame:
    """``col IS NULL OR col >= minimum``; no filter when ``minimum`` is None."""
    if minimum is None:
        return df
    return df.filter(F.col(col).isNull() | (F.col(col) >= F.lit(float(minimum))))
