"""Composed reports (P1-P6) and the catalog of registered queries."""

from meterwise.plans.reports import (
    history_report,
    forecast_period_report,
    usage_report,
    usage_totals,
    baseline_report,
    scenario_report,
    projected_totals,
    year_bucket_report,
    month_spine_report,
    dashboard,
)
from meterwise.plans.facts import (
    FactPaths,
    fact_paths,
    read_facts,
    write_account_monthly_table,
    write_facts,
)

__all__ = [
    "history_report",
    "forecast_period_report",
    "usage_report",
    "usage_totals",
    "baseline_report",
    "scenario_report",
    "projected_totals",
    "year_bucket_report",
    "month_spine_report",
    "dashboard",
    "FactPaths",
    "fact_paths",
    "read_facts",
    "write_facts",
    "write_account_monthly_table",
]
