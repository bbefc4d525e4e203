"""Month spines (S3), generated per row with ``explode(sequence(...))``.

A spine never goes through a join: each input row (one account, or the
single baseline row) generates its own months in the task that holds it, so
the all-accounts form keeps the accounts' partitioning and needs no shuffle
and no broadcast. The number of months per row is bounded by the report
parameters (or by the calendar span of the data), never by data volume.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.functions.dates import month_sequence, month_start


def with_month_spine(df: DataFrame, start: date, end: date, name: str = "month") -> DataFrame:
    """Each row of ``df`` repeated for every month from ``start``'s month to
    ``end``'s month (inclusive); a reversed range gives no rows."""
    return df.withColumn(name, F.explode(month_sequence(F.lit(start), F.lit(end))))


def account_month_spine(usage: DataFrame, date_col: str = "usage_date",
                        key: str = "account_id", name: str = "month") -> DataFrame:
    """Every month from each account's first to its last month with usage.

    One partial + final aggregation (min/max per account, map-side combined,
    so a hot account costs one row per task), then a per-row explode.
    """
    # month_start is monotonic: truncating the per-account min/max equals the
    # min/max of the truncated dates, with one truncation per account.
    bounds = usage.groupBy(key).agg(
        F.min(date_col).alias("_first"),
        F.max(date_col).alias("_last"),
    )
    return bounds.select(key, F.explode(month_sequence(month_start("_first"), month_start("_last")))
                         .alias(name))
