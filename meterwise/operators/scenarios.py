"""Scenarios (P5): projected usage per forecast month from a baseline.

Both rules put a year number on every forecast month (1 for the first 12
months from the forecast start month, 2 for the next 12, ...) and multiply
the baseline by a factor of that year:

* flat (the SQL dataset): Yr1 ``(1+g1)``, Yr2 ``(1+g1)(1+g2)``, Yr3 and later
  ``(1+g1)(1+g2)(1+g3)``; the first month is the forecast start's month even
  when the start is mid-month.
* compound (the app loop): keeps compounding after Yr3 (the year-4 factor
  carries g3, later years carry the fixed 5 %), and a month before the raw
  forecast start (a mid-month start) is dropped.

Factors are decimals computed from the parameters; the per-row work is
one explode and one multiplication, so the all-accounts form is a narrow
transformation of the per-account baselines (no join, no shuffle).

Baselines may also bring their own rates in a column ``growth_pct`` (an array,
see ``with_account_rates``); then every row's factor is folded from its array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.functions.dates import month_start, year_number
from meterwise.functions.growth import (
    by_year,
    compound_factor,
    compound_multipliers,
    flat_factor,
    flat_multipliers,
    rate_of_year,
)
from meterwise.operators.spine import with_month_spine
from meterwise.params import COMPOUND_CARRY_PCT, GROWTH_PCT_MAX, GROWTH_PCT_MIN, ScenarioParams

BASE = "baseline_dollars"
RATES = "growth_pct"
RATES_TYPE = "array<decimal(7,2)>"
#: A baseline that meets a folded factor: their product keeps all its digits
#: within 38. A larger one (1e15 dollars a month) fails the job.
EXACT = "decimal(19,4)"


def spine_years(p: ScenarioParams) -> int:
    """Number of forecast years the spine spans (parameter arithmetic)."""
    fs, fe = p.forecast_start, p.forecast_end
    months = (fe.year - fs.year) * 12 + (fe.month - fs.month) + 1
    return 0 if months <= 0 else (months - 1) // 12 + 1


def with_account_rates(baselines: DataFrame, rates: DataFrame, default: tuple, key: str = "account_id") -> DataFrame:
    """Join each account's yearly growth rates (``rates``: key, ``growth_pct``,
    an array of percentages) to its baseline; accounts without rates, or with
    a NULL array, get ``default``. An array of another length than ``default``,
    or with a NULL or a rate out of bounds, fails the job, as a parameter would.
    Both sides are one row per account, so the join adds a shuffle of narrow
    rows at most, and none where both already lie by account."""
    own = F.col(RATES).cast(RATES_TYPE)
    # a join that is not null-safe: no account is NULL
    bad = (F.size(own) != len(default)) | F.exists(
        own, lambda r: r.isNull() | (r < F.lit(GROWTH_PCT_MIN)) | (r > F.lit(GROWTH_PCT_MAX)))
    fallback = F.array(*[F.lit(g) for g in default]).cast(RATES_TYPE)
    checked = F.when(own.isNull(), fallback).when(
        bad, F.raise_error(F.concat(F.lit("growth rates out of bounds: "), F.to_json(own)))).otherwise(own)
    return baselines.join(rates.select(key, RATES), key, "left").withColumn(RATES, checked)


def _project(df: DataFrame, p: ScenarioParams, multipliers: list, factor) -> DataFrame:
    yr = F.col("yr_num")
    if RATES in df.columns:
        rate, times = rate_of_year(F.col(RATES), yr), factor(F.col(RATES), yr)
    else:
        rate, times = by_year(yr, list(p.growth_pct)), by_year(yr, multipliers)
    return (df.withColumn("year_bucket", F.concat(F.lit("Yr"), yr.cast("string")))
              .withColumn("organic_growth_pct", rate)
              .withColumn("projected_usage_dollars", F.round(F.col(BASE).cast(EXACT) * times, 2)
                          if RATES in df.columns else F.round(F.col(BASE) * times, 2)))


def flat_scenario(baselines: DataFrame, p: ScenarioParams) -> DataFrame:
    """Adds ``month, yr_num, year_bucket, organic_growth_pct,
    projected_usage_dollars`` to every baseline row (SQL rule)."""
    start_month = month_start(F.lit(p.forecast_start))
    years = max(spine_years(p), 1)
    spine = (with_month_spine(baselines, p.forecast_start, p.forecast_end)
             .withColumn("yr_num", year_number(F.col("month"), start_month))
             .filter(F.col("yr_num") >= 1))
    return _project(spine, p, flat_multipliers(p.growth_pct, years), flat_factor)


def compound_scenario(baselines: DataFrame, p: ScenarioParams) -> DataFrame:
    """Same columns, loop rule: months before the raw start are dropped and
    growth keeps compounding after Yr3."""
    start_month = month_start(F.lit(p.forecast_start))
    years = max(spine_years(p), 1)
    spine = (with_month_spine(baselines, p.forecast_start, p.forecast_end)
             .filter(F.col("month") >= F.lit(p.forecast_start))
             .withColumn("yr_num", year_number(F.col("month"), start_month)))
    return _project(spine, p, compound_multipliers(p.growth_pct, years, COMPOUND_CARRY_PCT),
                    lambda rates, yr: compound_factor(rates, yr, COMPOUND_CARRY_PCT))
