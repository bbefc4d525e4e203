"""Yearly growth rates from each account's own usage (rates as data).

A rate is the change of an account's total from one calendar year to the next,
in percent with two decimals, half up. It is exact: totals are decimals, and the
quotient is an integer division in hundredths of a percent, so no double is
rounded. Rates outside the bounds of the parameters become the nearest bound;
where a year has no positive total to grow from, the default rate stands.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.operators.filters import in_date_range
from meterwise.params import GROWTH_PCT_DEFAULT, GROWTH_PCT_MAX, GROWTH_PCT_MIN

RATE = "decimal(7,2)"


def growth_rate(before: Column, after: Column, default: Decimal = GROWTH_PCT_DEFAULT) -> Column:
    """``100 * (after - before) / before`` in bounds; ``default`` where
    ``before`` is not positive or NULL. A NULL or negative ``after`` is 0."""
    whole = lambda c: (c.cast("decimal(28,4)") * 10000).cast("decimal(32,0)")
    b, a = whole(before), F.greatest(whole(F.coalesce(after, F.lit(0))), F.lit(0).cast("decimal(32,0)"))
    top = int(GROWTH_PCT_MAX) // 100 + 1
    # hundredths of a percent of after / before: all terms are positive, so half up is plain
    share = F.call_function("div", a * 20000 + b, b * 2)
    rate = (share - 10000).cast("decimal(20,0)") * F.lit(Decimal("0.01"))
    return (F.when(F.coalesce(b <= 0, F.lit(True)), F.lit(default))
            .when(a >= b * top, F.lit(GROWTH_PCT_MAX))
            .otherwise(F.greatest(rate, F.lit(GROWTH_PCT_MIN)))).cast(RATE)


def account_growth_rates(usage: DataFrame, last_year: int, years: int = 3,
                         default: Decimal = GROWTH_PCT_DEFAULT, date_col: str = "usage_date",
                         value: str = "dollars", key: str = "account_id") -> DataFrame:
    """(key, ``growth_pct``): the account's rates of the ``years`` calendar
    years up to ``last_year``, oldest first, for every account with usage in
    those years or the one before them. One aggregation with conditional
    sums (partial + final, so a hot account is one row per task); the date
    range is filtered first and prunes month folders."""
    span = range(last_year - years, last_year + 1)
    rows = in_date_range(usage, date(span[0], 1, 1), date(last_year, 12, 31), date_col)
    totals = rows.groupBy(key).agg(*[
        F.coalesce(F.sum(F.when(F.year(date_col) == y, F.col(value))), F.lit(0)).alias(f"_y{y}") for y in span])
    rates = [growth_rate(F.col(f"_y{y - 1}"), F.col(f"_y{y}"), default) for y in span[1:]]
    return totals.select(key, F.array(*rates).alias("growth_pct"))
