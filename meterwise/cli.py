"""Command-line front end: run one report and print or write it.

    python -m meterwise.cli history --table main.gold.account_monthly --mapping source \\
        --pattern '%acme%' --start 2024-01-01 --end 2025-12-31 --min-growth 5 --out /shared/h --format csv
    python -m meterwise.cli scenario --table main.gold.usage_lines --mapping source \\
        --account 001xx --history-end 2025-12-31 --forecast-start 2026-01-01 \\
        --forecast-end 2028-12-01 --growth 5 5 5 --rule flat
    python -m meterwise.cli usage --testdata /root/testdata/sf0.01 --account 42 \\
        --start 1996-01-01 --end 2000-12-31

``--table`` is a catalog table name or a Parquet path; with ``--catalog`` and
``--schema`` it is one name whose parts are quoted. ``--limit all`` gives a
whole report. ``dashboard`` runs the usage report and the scenario of one
account, ``consumption`` the history and the forecast period, each from one
parameter set with the front ends' defaults. ``--mapping source`` binds the production column names, ``neutral`` (default) expects the names
of ``meterwise.schemas``. ``--testdata DIR`` builds the facts from the
TPC-H-style test tables instead. The session comes from the environment
(``spark-submit`` / cluster settings); nothing is collected except the rows
``--show`` prints.
"""

from __future__ import annotations

import argparse
import sys
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from meterwise import schemas
from meterwise.params import (
    GROWTH_PCT_DEFAULT,
    HISTORY_LIMIT_DEFAULT,
    USAGE_LIMIT_DEFAULT,
    BaselineParams,
    ConsumptionParams,
    DashboardParams,
    ForecastPeriodParams,
    HistoryParams,
    ScenarioParams,
    UsageParams,
)
from meterwise.plans import reports
from meterwise.sources.adapters import account_monthly, usage_lines
from meterwise.sources.sinks import FORMATS, write_report
from meterwise.sources.tables import SourceTables, qualified_name, read_account_monthly, read_usage_lines

MONTHLY_REPORTS = ("history", "forecast-period", "consumption")


def _date(s: str) -> date:
    return date.fromisoformat(s.strip())


def _limit(s: str) -> int | None:
    return None if s.strip().lower() == "all" else int(s)


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="meterwise", description="Run a consumption report.")
    sub = ap.add_subparsers(dest="report", required=True)

    def common(p):
        src = p.add_mutually_exclusive_group(required=True)
        src.add_argument("--table", help="catalog table name or Parquet path of the fact table")
        src.add_argument("--testdata", help="folder of the TPC-H-style test tables")
        p.add_argument("--catalog", help="catalog of --table")
        p.add_argument("--schema", help="schema of --table")
        p.add_argument("--mapping", choices=("neutral", "source"), default="neutral")
        p.add_argument("--out", help="write the whole result here instead of printing")
        p.add_argument("--format", choices=FORMATS, default="csv")
        p.add_argument("--overwrite", action="store_true", help="replace what is at --out")
        p.add_argument("--show", type=int, default=50, help="rows to print when --out is absent")

    h = sub.add_parser("history", help="monthly history with MoM growth")
    common(h)
    h.add_argument("--pattern", default="%")
    h.add_argument("--start", type=_date, default=date(2024, 1, 1))
    h.add_argument("--end", type=_date, default=date(2026, 1, 1))
    h.add_argument("--min-growth", default=None)
    h.add_argument("--strict-calendar", action="store_true", help="compare with the previous calendar month, not row")
    h.add_argument("--limit", type=_limit, default=HISTORY_LIMIT_DEFAULT)

    f = sub.add_parser("forecast-period", help="actual vs baseline and forecasts")
    common(f)
    f.add_argument("--pattern", default="%")
    f.add_argument("--start", type=_date, default=date(2025, 1, 1))
    f.add_argument("--end", type=_date, default=date(2026, 6, 1))
    f.add_argument("--limit", type=_limit, default=HISTORY_LIMIT_DEFAULT)

    u = sub.add_parser("usage", help="usage lines of one account")
    common(u)
    u.add_argument("--account", required=True)
    u.add_argument("--start", type=_date, required=True)
    u.add_argument("--end", type=_date, required=True)
    u.add_argument("--limit", type=_limit, default=USAGE_LIMIT_DEFAULT)
    u.add_argument("--totals", choices=("month", "sku"), default=None,
                   help="dollars per month or SKU instead of lines")

    b = sub.add_parser("baseline", help="trailing or latest-month baseline")
    common(b)
    b.add_argument("--account", default=None, help="omit for every account")
    b.add_argument("--end", type=_date, required=True)
    b.add_argument("--mode", choices=("trailing", "latest_month"), default="trailing")
    b.add_argument("--default", default="0")
    b.add_argument("--start", type=_date, default=None)

    s = sub.add_parser("scenario", help="projected usage by forecast month")
    common(s)
    s.add_argument("--account", default=None, help="omit for every account")
    s.add_argument("--history-end", type=_date, required=True)
    s.add_argument("--history-start", type=_date, default=None)
    s.add_argument("--forecast-start", type=_date, required=True)
    s.add_argument("--forecast-end", type=_date, required=True)
    s.add_argument("--growth", nargs=3, default=[str(GROWTH_PCT_DEFAULT)] * 3)
    s.add_argument("--rule", choices=("flat", "compound"), default="flat")
    s.add_argument("--totals", choices=("month",), default=None, help="projected dollars per month")
    s.add_argument("--own-growth", action="store_true", help="every account's rates from its own last three years")

    d = sub.add_parser("dashboard", help="usage report and scenario of one account")
    common(d)
    d.add_argument("--account", required=True)
    d.add_argument("--today", type=_date, required=True, help="history: the 12 months before; forecast: 36 after")
    d.add_argument("--growth", nargs=3, default=[str(GROWTH_PCT_DEFAULT)] * 3)
    d.add_argument("--rule", choices=("flat", "compound"), default="compound")
    d.add_argument("--limit", type=_limit, default=USAGE_LIMIT_DEFAULT)

    c = sub.add_parser("consumption", help="history and forecast period with one pattern and limit")
    common(c)
    c.add_argument("--pattern", default="%")
    for name in ("history-start", "history-end", "forecast-start", "forecast-end"):
        c.add_argument(f"--{name}", type=_date, default=getattr(ConsumptionParams, name.replace("-", "_")))
    c.add_argument("--min-growth", default=None)
    c.add_argument("--limit", type=_limit, default=HISTORY_LIMIT_DEFAULT)
    return ap


def _fact(spark: SparkSession, args) -> DataFrame:
    monthly = args.report in MONTHLY_REPORTS
    if args.testdata:
        tables = SourceTables(spark, args.testdata)
        return account_monthly(tables) if monthly else usage_lines(tables)
    table = args.table
    if args.catalog or args.schema:
        table = qualified_name(*[p for p in (args.catalog, args.schema) if p], table)
    if monthly:
        mapping = schemas.ACCOUNT_MONTHLY_SOURCE_COLUMNS if args.mapping == "source" else None
        return read_account_monthly(spark, table, mapping)
    mapping = schemas.USAGE_LINES_SOURCE_COLUMNS if args.mapping == "source" else None
    return read_usage_lines(spark, table, mapping)


def build(spark: SparkSession, args) -> dict[str, tuple[DataFrame, int | None]]:
    """The report's DataFrames by name (a single one is unnamed), each with
    its row limit."""
    fact = _fact(spark, args)
    if args.report == "history":
        p = HistoryParams(args.pattern, args.start, args.end, args.min_growth, args.limit, args.strict_calendar)
        return {"": (reports.history_report(fact, p), p.limit)}
    if args.report == "forecast-period":
        p = ForecastPeriodParams(args.pattern, args.start, args.end, args.limit)
        return {"": (reports.forecast_period_report(fact, p), p.limit)}
    if args.report == "consumption":
        p = ConsumptionParams(args.pattern, args.history_start, args.history_end, args.forecast_start,
                              args.forecast_end, args.min_growth, args.limit)
        return {"history": (reports.history_report(fact, p.history()), p.history().limit),
                "forecast": (reports.forecast_period_report(fact, p.forecast()), p.forecast().limit)}
    if args.report == "usage":
        if args.totals:
            p = UsageParams(args.account, args.start, args.end)
            return {"": (reports.usage_totals(fact, p, args.totals), None)}
        p = UsageParams(args.account, args.start, args.end, args.limit)
        return {"": (reports.usage_report(fact, p), p.limit)}
    if args.report == "dashboard":
        p = DashboardParams.for_today(args.account, args.today, limit=args.limit,
                                      growth_pct=tuple(Decimal(g) for g in args.growth))
        usage, scenario = reports.dashboard(fact, p, args.rule)
        return {"usage": (usage, p.usage().limit), "scenario": (scenario, None)}
    if args.report == "baseline":
        p = BaselineParams(args.account, args.end, args.mode, Decimal(args.default), args.start)
        return {"": (reports.baseline_report(fact, p), None)}
    p = ScenarioParams(args.account, args.history_end, args.forecast_start, args.forecast_end,
                       tuple(Decimal(g) for g in args.growth), args.history_start)
    if args.totals:
        return {"": (reports.projected_totals(fact, p, args.rule), None)}
    if args.own_growth:
        return {"": (reports.own_growth_scenario(fact, p, args.rule), None)}
    return {"": (reports.scenario_report(fact, p, args.rule), None)}


def main(argv=None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"meterwise-{args.report}").getOrCreate()
    for name, (df, limit) in build(spark, args).items():
        if args.out:
            path = f"{args.out.rstrip('/')}/{name}" if name else args.out
            written = write_report(df, path, args.format, single_file_rows=limit, overwrite=args.overwrite)
            print(written or f"no rows: {path} not written")
        else:
            df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
