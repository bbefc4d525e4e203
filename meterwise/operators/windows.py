"""Previous-row and previous-month windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions.dates import month_ordinal
from meterwise.functions.money import pct_change


def grain_error(key: str, order: str) -> Column:
    """Fails the job: two rows of one account and month have no order."""
    return F.raise_error(F.concat(F.lit(f"more than one row for {key} "), F.col(key).cast("string"),
                                  F.lit(f" and {order} "), F.col(order).cast("string")))


def with_previous_amount(df: DataFrame, value: str = "amount", key: str = "account_id",
                         order: str = "month", prev_name: str = "prev_amount",
                         pct_name: str = "mom_growth_pct", strict_calendar: bool = False) -> DataFrame:
    """Add the previous value per key and the percent change.

    By default that is the previous *row*: a month missing from the input is
    skipped. With ``strict_calendar`` it is the previous calendar month, NULL
    where that month has no row: a RANGE frame of one month back over the
    month's ordinal number, so gaps cost neither a spine nor a join.

    Either form is one window, and it checks the grain as it goes: a second
    row of an account and month fails the job instead of giving an arbitrary
    predecessor. The window shuffles on ``key`` only; one key holds one row per
    month, so a partition stays small whatever the skew of the raw usage.
    """
    w = Window.partitionBy(key)
    held = "_previous"
    if strict_calendar:
        w = w.orderBy(month_ordinal(order))
        twice = F.count(F.lit(1)).over(w.rangeBetween(0, 0)) > 1
        seen = F.struct(F.max(value).over(w.rangeBetween(-1, -1)).alias("value"), twice.alias("twice"))
        df = df.withColumn(held, seen)
        twice, before = F.col(held)["twice"], F.col(held)["value"]
    else:
        # a column of its own, so that the window is evaluated once
        df = df.withColumn(held, F.lag(F.struct(order, value), 1).over(w.orderBy(order)))
        twice, before = F.col(held)[order] == F.col(order), F.col(held)[value]
    prev = F.when(twice, grain_error(key, order)).otherwise(before)
    return (df.withColumn(prev_name, prev).drop(held)
            .withColumn(pct_name, pct_change(F.col(value), F.col(prev_name))))


def with_grain_checked(df: DataFrame, key: str = "account_id", order: str = "month") -> DataFrame:
    """``df``, failing the job on a second row of one key and month. For
    reports without a window of their own: this one shuffles by key and month,
    so no key is hot."""
    month = month_ordinal(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key, month))
    # the raised value stands for a column that every report reads
    return df.withColumn(key, F.when(n > 1, grain_error(key, order)).otherwise(F.col(key)))
