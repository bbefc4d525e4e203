"""Reports: typed parameters in, DataFrame out.

Each function takes a bound fact table (see ``meterwise.schemas``) and a
parameter object, and returns a lazy DataFrame; Catalyst pushes the filters
and column pruning down to the scan. Money leaves a report rounded half-up
to cents (decimal), then as double.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.functions.dates import month_start, year_bucket, year_number
from meterwise.functions.money import round_money
from meterwise.operators.baselines import latest_month_baseline, trailing_baseline
from meterwise.operators.filters import (
    for_account,
    in_date_range,
    keep_growth_at_least,
    positive_amount,
)
from meterwise.operators.growth_rates import account_growth_rates
from meterwise.operators.names import accounts_named
from meterwise.operators.scenarios import compound_scenario, flat_scenario, with_account_rates
from meterwise.operators.spine import account_month_spine
from meterwise.operators.topk import top_rows
from meterwise.operators.totals import totals_by
from meterwise.operators.windows import with_previous_amount
from meterwise.params import (
    SCENARIO_DEFAULT_BASELINE,
    BaselineParams,
    DashboardParams,
    ForecastPeriodParams,
    HistoryParams,
    ScenarioParams,
    UsageParams,
)

MONEY_A = ("baseline", "model_forecast", "submitted_forecast")


def history_report(account_monthly: DataFrame, p: HistoryParams, names: DataFrame | None = None) -> DataFrame:
    """Monthly history with month-over-month growth.

    Order matters: name and date filters run before the previous-row window
    (the first month in range has no predecessor), ``amount > 0`` and the
    growth threshold run after it on the unrounded values (a hidden zero
    month is still its successor's predecessor). ``p.strict_calendar`` compares
    with the previous calendar month instead of the previous row. ``names`` is
    the name dimension of written facts.
    """
    scoped = (account_monthly
              .transform(accounts_named, names, p.name_pattern)
              .transform(in_date_range, p.start, p.end, "month"))
    shown = (with_previous_amount(scoped, strict_calendar=p.strict_calendar)
             .transform(positive_amount)
             .transform(keep_growth_at_least, p.min_growth_pct))
    out = shown.select(
        "account_id", "account_name", "month",
        round_money("amount").alias("amount"),
        round_money("prev_amount").alias("prev_amount"),
        F.round("mom_growth_pct", 2).alias("mom_growth_pct"),
        *[round_money(c).alias(c) for c in MONEY_A],
        "unit", "sub_unit",
    )
    top = top_rows(out, [F.col("account_name").asc_nulls_first(), F.col("month").desc_nulls_last()],
                   p.limit, [F.col("account_id").asc_nulls_first()])
    return top.drop("account_id")


def forecast_period_report(account_monthly: DataFrame, p: ForecastPeriodParams,
                           names: DataFrame | None = None) -> DataFrame:
    """Actual versus baseline and the two forecasts (no ``amount > 0``)."""
    scoped = (account_monthly
              .transform(accounts_named, names, p.name_pattern)
              .transform(in_date_range, p.start, p.end, "month"))
    out = scoped.select(
        "account_id", "account_name", "month",
        round_money("amount").alias("amount"),
        *[round_money(c).alias(c) for c in MONEY_A],
        "unit", "sub_unit",
    )
    top = top_rows(out, [F.col("account_name").asc_nulls_first(), F.col("month").asc_nulls_first()],
                   p.limit, [F.col("account_id").asc_nulls_first()])
    return top.drop("account_id")


USAGE_COLUMNS = ("account_id", "workspace_id", "workspace_name", "sku_name", "month",
                 "quantity", "dollars", "dollars_at_list")


def usage_report(usage_lines: DataFrame, p: UsageParams) -> DataFrame:
    """Usage lines of an account, day truncated to month, not grouped.

    Sorted by month and dollars (both descending); the remaining columns
    break ties so the rows kept at the limit are deterministic.
    """
    rows = (usage_lines
            .transform(for_account, p.account_id)
            .transform(in_date_range, p.start, p.end, "usage_date")
            .withColumn("month", month_start("usage_date")))
    order = [F.col("month").desc_nulls_last(), F.col("dollars").desc_nulls_last()]
    ties = [F.col(c).asc_nulls_first() for c in
            ("account_id", "workspace_id", "workspace_name", "sku_name", "quantity", "dollars_at_list")]
    top = top_rows(rows.select(*USAGE_COLUMNS), order, p.limit, ties)
    return top.select(
        "account_id", "workspace_id", "workspace_name", "sku_name", "month",
        *[F.col(c).cast("double").alias(c) for c in ("quantity", "dollars", "dollars_at_list")])


def usage_totals(usage_lines: DataFrame, p: UsageParams, by: str) -> DataFrame:
    """Dollars per month (``by="month"``) or per SKU (``by="sku"``) over
    the usage report's rows (all of them, not only the capped ones)."""
    rows = (usage_lines
            .transform(for_account, p.account_id)
            .transform(in_date_range, p.start, p.end, "usage_date"))
    if by == "month":
        key = month_start("usage_date").alias("month")
    elif by == "sku":
        key = F.col("sku_name")
    else:
        raise ValueError(f"by must be 'month' or 'sku', got {by!r}")
    totals = totals_by(rows, key, "dollars", "dollars")
    return totals.withColumn("dollars", round_money("dollars"))


def sku_totals(dollars: DataFrame) -> DataFrame:
    """P6 by SKU over (``sku_name``, ``dollars``) rows that are already summed
    in part, such as one row per part."""
    return totals_by(dollars, F.col("sku_name"), "dollars", "dollars").withColumn("dollars", round_money("dollars"))


def baseline_report(usage_lines: DataFrame, p: BaselineParams, accounts: DataFrame | None = None,
                    months: DataFrame | None = None) -> DataFrame:
    """``(baseline_dollars)`` for one account, or
    ``(account_id, baseline_dollars)`` per account when ``p.account_id`` is
    None. With an account list (``accounts``) only the window is read; with a
    month summary too (``months``) the latest-month form stops at the month
    that settles the last account."""
    every = p.account_id is None
    if p.mode == "trailing":
        out = trailing_baseline(usage_lines, p.end, p.default, p.account_id, every, accounts)
    else:
        out = latest_month_baseline(usage_lines, p.start, p.end, p.account_id, every, accounts, months=months)
    return out.withColumn("baseline_dollars", F.col("baseline_dollars").cast("double"))


def _projection(usage_lines: DataFrame, p: ScenarioParams, rule: str, accounts: DataFrame | None,
                months: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Baseline(s) plus the projected months; money still exact decimal."""
    every = p.account_id is None
    if rates is not None and not every:
        raise ValueError("rates of accounts need the all-accounts form")
    rated = (lambda base: base) if rates is None else (lambda base: with_account_rates(base, rates, p.growth_pct))
    if rule == "flat":
        base = trailing_baseline(usage_lines, p.history_end, SCENARIO_DEFAULT_BASELINE,
                                 p.account_id, every, accounts)
        return flat_scenario(rated(base), p)
    if rule == "compound":
        if p.history_start is None:
            raise ValueError("the compound rule needs history_start for its baseline")
        base = latest_month_baseline(usage_lines, p.history_start, p.history_end,
                                     p.account_id, every, accounts, months=months)
        return compound_scenario(rated(base), p)
    raise ValueError(f"rule must be 'flat' or 'compound', got {rule!r}")


def scenario_report(usage_lines: DataFrame, p: ScenarioParams, rule: str = "flat",
                    ordered: bool | None = None, accounts: DataFrame | None = None,
                    months: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
    """P5: projected usage by forecast month.

    ``rule="flat"`` projects from the trailing baseline (default 1);
    ``rule="compound"`` from the latest-month baseline over
    ``history_start..history_end``. With ``p.account_id=None`` every account
    is projected in one pass and ``account_id`` leads the output.
    ``ordered`` sorts by month (default: only for a single account, whose
    output is small). ``rates`` (account_id, growth_pct) gives accounts yearly
    rates of their own, the others keep those of ``p``.
    """
    every = p.account_id is None
    keys = ["account_id"] if every else []
    out = _projection(usage_lines, p, rule, accounts, months, rates).select(
        *keys, "month", "year_bucket",
        round_money("organic_growth_pct").alias("organic_growth_pct"),
        F.col("projected_usage_dollars").cast("double").alias("projected_usage_dollars"),
    )
    if ordered is None:
        ordered = not every
    return out.orderBy(*keys, "month") if ordered else out


def own_growth_scenario(usage_lines: DataFrame, p: ScenarioParams, rule: str = "compound",
                        accounts: DataFrame | None = None, months: DataFrame | None = None) -> DataFrame:
    """P5 for every account with the growth rates of its own last three
    calendar years up to ``p.history_end``'s, oldest first, within the bounds
    of the rate parameters (``p.growth_pct`` where an account has no usage)."""
    rates = account_growth_rates(usage_lines, p.history_end.year)
    return scenario_report(usage_lines, p, rule, accounts=accounts, months=months, rates=rates)


def projected_totals(usage_lines: DataFrame, p: ScenarioParams, rule: str = "flat",
                     accounts: DataFrame | None = None, months: DataFrame | None = None) -> DataFrame:
    """Projected dollars per forecast month, summed over the accounts
    (exact sum of the rounded per-account projections)."""
    totals = totals_by(_projection(usage_lines, p, rule, accounts, months), F.col("month"),
                       "projected_usage_dollars", "projected_usage_dollars")
    return totals.withColumn("projected_usage_dollars", F.col("projected_usage_dollars").cast("double"))


def year_bucket_report(usage_lines: DataFrame, forecast_start: date) -> DataFrame:
    """Months with usage and dollars per year bucket: ``Historical`` before
    the raw ``forecast_start``, else ``Yr<n>`` counted from its month."""
    monthly = totals_by(usage_lines, month_start("usage_date").alias("month"), "dollars", "dollars")
    start_month = month_start(F.lit(forecast_start))
    past = F.col("month") < F.lit(forecast_start)
    yr = F.when(~past, year_number(F.col("month"), start_month))
    return (monthly.groupBy(yr.alias("yr_num"), year_bucket(F.col("month"), F.lit(forecast_start)).alias("year_bucket"))
            .agg(F.count(F.lit(1)).alias("months"), round_money(F.sum("dollars")).alias("dollars")))


def month_spine_report(usage_lines: DataFrame) -> DataFrame:
    """Every month from each account's first to last month with usage."""
    return account_month_spine(usage_lines)


def dashboard(usage_lines: DataFrame, p: DashboardParams,
              rule: str = "compound") -> tuple[DataFrame, DataFrame]:
    """The usage report and the scenario for one account from one parameter
    set (the scenario's baseline uses the same account and history range)."""
    return usage_report(usage_lines, p.usage()), scenario_report(usage_lines, p.scenario(), rule)
