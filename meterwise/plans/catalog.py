"""Registered queries: each report with fixed parameters over the test tables.

Each entry names the fact table it reads, the report that runs on it, and
the exact pre-filters the adapter may add for pushdown. ``QUERIES`` maps a
key to a callable ``(spark, folder) -> DataFrame`` that builds the fact from
the whole test tables; ``Registered.on_facts`` runs the same report on
already written facts. Parameters are those listed for the driver
queries in FIXTURES.md.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.operators.baselines import trailing_start
from meterwise.params import (
    BaselineParams,
    ForecastPeriodParams,
    HistoryParams,
    ScenarioParams,
    UsageParams,
)
from meterwise.plans import reports
from meterwise.plans.facts import FactPaths, Facts, read_facts, refresh_facts, write_facts
from meterwise.sources.adapters import ORDER_LINES, account_monthly, dollars_by_part, usage_lines, with_order_lines
from meterwise.sources.tables import SourceTables

RATES = (Decimal(5), Decimal(10), Decimal(20))

HISTORY_ALL = HistoryParams("%", date(1996, 1, 1), date(2000, 12, 31))
HISTORY_MIN_GROWTH = HistoryParams("%", date(1996, 1, 1), date(2000, 12, 31), 5)
HISTORY_PATTERN = HistoryParams("%customer#0000000%", date(1996, 1, 1), date(2000, 12, 31), 5)
HISTORY_TOP = HistoryParams("%", date(1996, 1, 1), date(2000, 12, 31), None, 500)
FORECAST = ForecastPeriodParams("%", date(2000, 1, 1), date(2001, 6, 1))
FORECAST_TOP = ForecastPeriodParams("%", date(2000, 1, 1), date(2001, 6, 1), 100)
USAGE_ONE = UsageParams("42", date(1996, 1, 1), date(2000, 12, 31))
USAGE_TOP = UsageParams(None, date(1996, 1, 1), date(2000, 12, 31), 200)
HISTORY_STRICT = HistoryParams("%", date(1996, 1, 1), date(2000, 12, 31), strict_calendar=True)
USAGE_ALL = UsageParams(None, date(1996, 1, 1), date(2000, 12, 31))
# Account 9 has usage in November and December 2000 at every scale of the test
# tables; no account is called -1.
BASELINE_TRAILING = BaselineParams("9", date(2000, 12, 31), "trailing", Decimal(0))
BASELINE_TRAILING_NONE = BaselineParams("-1", date(2000, 12, 31), "trailing", Decimal(0))
BASELINE_TRAILING_ALL = BaselineParams(None, date(2000, 12, 31), "trailing", Decimal(0))
BASELINE_LATEST_ALL = BaselineParams(None, date(2000, 12, 31), "latest_month",
                                     start=date(1996, 1, 1))
SCENARIO_FLAT = ScenarioParams("9", date(2000, 12, 31), date(2001, 1, 1), date(2003, 12, 1), RATES)
SCENARIO_FLAT_NONE = ScenarioParams("-1", date(2000, 12, 31), date(2001, 1, 1), date(2003, 12, 1), RATES)
SCENARIO_FLAT_ALL = ScenarioParams(None, date(2000, 12, 31), date(2001, 1, 1), date(2003, 12, 1), RATES)
SCENARIO_COMPOUND = ScenarioParams("42", date(2000, 12, 31), date(2001, 1, 1), date(2006, 12, 1),
                                   RATES, history_start=date(1996, 1, 1))
SCENARIO_COMPOUND_ALL = ScenarioParams(None, date(2000, 12, 31), date(2001, 1, 15), date(2006, 12, 1),
                                       RATES, history_start=date(1996, 1, 1))
SCENARIO_OWN_GROWTH = ScenarioParams(None, date(2000, 12, 31), date(2001, 1, 1), date(2006, 12, 1),
                                     RATES, history_start=date(1996, 1, 1))
# Facts are first written without the orders from this day on (their lines
# too), then the months that these change are refreshed.
REFRESH_FROM = date(2000, 7, 1)
YEAR_BUCKET_START = date(1998, 1, 15)

BASE_COLUMNS = ("account_id", "usage_date", "dollars")
MONTHLY, USAGE = "account_monthly", "usage_lines"


@dataclass(frozen=True)
class Registered:
    """``build`` runs the report on its fact; on written facts, it also takes
    the account list and the month totals (``every``), or the names (``named``)."""

    fact: str
    build: Callable[..., DataFrame]
    months: tuple[date, date] | None = None
    dates: tuple[date, date] | None = None
    columns: tuple[str, ...] | None = None
    account_id: str | None = None
    name_pattern: str = "%"
    every: bool = False
    named: bool = False
    tables_only: Callable[[SourceTables], DataFrame] | None = None

    def on_tables(self, spark: SparkSession, folder: str) -> DataFrame:
        tables = SourceTables(spark, folder)
        if self.tables_only is not None:
            return self.tables_only(tables)
        if self.fact == MONTHLY:
            return self.build(account_monthly(tables, self.months, self.name_pattern))
        return self.build(usage_lines(tables, columns=list(self.columns) if self.columns else None,
                                      dates=self.dates, account_id=self.account_id))

    def on_facts(self, facts: Facts) -> DataFrame:
        fact = facts.monthly if self.fact == MONTHLY else facts.usage
        if self.every:
            return self.build(fact, facts.accounts, facts.months)
        return self.build(fact, facts.names) if self.named else self.build(fact)


def _trailing_dates(end: date) -> tuple[date, date]:
    return trailing_start(end), end


def _history(p: HistoryParams) -> Registered:
    return Registered(MONTHLY, lambda f, names=None: reports.history_report(f, p, names), months=(p.start, p.end),
                      name_pattern=p.name_pattern, named=True)


def _forecast(p: ForecastPeriodParams) -> Registered:
    return Registered(MONTHLY, lambda f, names=None: reports.forecast_period_report(f, p, names),
                      months=(p.start, p.end), name_pattern=p.name_pattern, named=True)


def _usage(p: UsageParams) -> Registered:
    return Registered(USAGE, lambda f: reports.usage_report(f, p), dates=(p.start, p.end), account_id=p.account_id)


def _usage_totals(by: str) -> Registered:
    p = USAGE_ALL
    cols = BASE_COLUMNS + (("sku_name",) if by == "sku" else ())
    by_part = None
    if by == "sku":
        def by_part(tables):
            return reports.sku_totals(dollars_by_part(tables, (p.start, p.end)))
    return Registered(USAGE, lambda f: reports.usage_totals(f, p, by), dates=(p.start, p.end),
                      columns=cols, tables_only=by_part)


def _baseline_one(p: BaselineParams) -> Registered:
    return Registered(USAGE, lambda f: reports.baseline_report(f, p), dates=_trailing_dates(p.end),
                      columns=BASE_COLUMNS, account_id=p.account_id)


def _flat_one(p: ScenarioParams) -> Registered:
    return Registered(USAGE, lambda f: reports.scenario_report(f, p, "flat"), dates=_trailing_dates(p.history_end),
                      columns=BASE_COLUMNS, account_id=p.account_id)


def _for_every(build: Callable[..., DataFrame]) -> Registered:
    return Registered(USAGE, lambda f, accounts=None, months=None: build(f, accounts, months), columns=BASE_COLUMNS,
                      every=True)


def _served(key: str) -> Callable[[SparkSession, str], DataFrame]:
    """The report on facts that are written first and then bound and read."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return REGISTERED[key].on_facts(read_facts(spark, write_facts(spark, SourceTables(spark, folder))))

    return run


def refreshed(spark: SparkSession, folder: str) -> FactPaths:
    """Facts written before the orders from ``REFRESH_FROM`` on came in, then
    refreshed by the months that these orders and their lines fall into. The
    lines meet their orders once, for both."""
    tables = with_order_lines(SourceTables(spark, folder))
    lines = tables(ORDER_LINES)
    late = F.col("o_orderdate") >= F.lit(REFRESH_FROM)
    early = tables.copy().with_table("orders", tables("orders").where(~late)).with_table(
        ORDER_LINES, lines.where(~late))
    paths = write_facts(spark, early)
    shipped = lines.where(late).agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b")).first()
    ordered = tables("orders").where(late).agg(F.max("o_orderdate").cast("date").alias("b")).first()
    return refresh_facts(spark, tables, paths, monthly=(REFRESH_FROM, ordered["b"] or REFRESH_FROM),
                         usage=(shipped["a"] or REFRESH_FROM, shipped["b"] or REFRESH_FROM))


def _refreshed(key: str) -> Callable[[SparkSession, str], DataFrame]:
    """The report on facts that were written early and refreshed since."""
    return lambda spark, folder: REGISTERED[key].on_facts(read_facts(spark, refreshed(spark, folder)))


REGISTERED: dict[str, Registered] = {
    "history_mom": _history(HISTORY_ALL),
    "history_mom_min_growth": _history(HISTORY_MIN_GROWTH),
    "history_name_pattern": _history(HISTORY_PATTERN),
    "history_top": _history(HISTORY_TOP),
    "history_strict_calendar": _history(HISTORY_STRICT),
    "forecast_period": _forecast(FORECAST),
    "forecast_period_top": _forecast(FORECAST_TOP),
    "usage_report": _usage(USAGE_ONE),
    "usage_report_top": _usage(USAGE_TOP),
    "usage_by_month": _usage_totals("month"),
    "usage_by_sku": _usage_totals("sku"),
    "month_spine": Registered(USAGE, reports.month_spine_report, columns=("account_id", "usage_date")),
    "year_bucket": Registered(USAGE, lambda f: reports.year_bucket_report(f, YEAR_BUCKET_START),
                              columns=BASE_COLUMNS),
    "baseline_trailing": _baseline_one(BASELINE_TRAILING),
    "baseline_trailing_none": _baseline_one(BASELINE_TRAILING_NONE),
    "baseline_trailing_all": _for_every(lambda f, a, m: reports.baseline_report(f, BASELINE_TRAILING_ALL, a)),
    "baseline_latest_month": _for_every(lambda f, a, m: reports.baseline_report(f, BASELINE_LATEST_ALL, a, m)),
    "scenario_flat": _flat_one(SCENARIO_FLAT),
    "scenario_flat_none": _flat_one(SCENARIO_FLAT_NONE),
    "scenario_flat_all": _for_every(
        lambda f, a, m: reports.scenario_report(f, SCENARIO_FLAT_ALL, "flat", accounts=a)),
    "scenario_compound": Registered(
        USAGE, lambda f: reports.scenario_report(f, SCENARIO_COMPOUND, "compound"),
        dates=(SCENARIO_COMPOUND.history_start, SCENARIO_COMPOUND.history_end), columns=BASE_COLUMNS,
        account_id=SCENARIO_COMPOUND.account_id),
    "scenario_compound_all": _for_every(
        lambda f, a, m: reports.scenario_report(f, SCENARIO_COMPOUND_ALL, "compound", accounts=a, months=m)),
    "scenario_compound_own_growth": _for_every(
        lambda f, a, m: reports.own_growth_scenario(f, SCENARIO_OWN_GROWTH, "compound", a, m)),
    "projected_by_month": _for_every(lambda f, a, m: reports.projected_totals(f, SCENARIO_FLAT_ALL, "flat", a)),
    "projected_by_month_compound": _for_every(
        lambda f, a, m: reports.projected_totals(f, SCENARIO_COMPOUND_ALL, "compound", a, m)),
}

# The same reports on written and bound facts: one key per table.
SERVED = {"served_history_mom": "history_mom", "served_baseline_latest_month": "baseline_latest_month",
          "served_usage_by_month": "usage_by_month", "served_history_name_pattern": "history_name_pattern",
          "served_scenario_compound_own_growth": "scenario_compound_own_growth"}
# On facts of which some months were refreshed.
REFRESHED = {"refreshed_history_mom": "history_mom", "refreshed_baseline_latest_month": "baseline_latest_month"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{key: reg.on_tables for key, reg in REGISTERED.items()},
    **{key: _served(of) for key, of in SERVED.items()},
    **{key: _refreshed(of) for key, of in REFRESHED.items()},
}
