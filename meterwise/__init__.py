"""meterwise: account consumption and forecast reports as Spark DataFrame jobs.

Every report is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions. Nothing is collected to the driver inside a report; the only
driver-side arithmetic is on report *parameters* (dates, growth rates).
"""

from meterwise.params import (
    HistoryParams,
    ForecastPeriodParams,
    UsageParams,
    BaselineParams,
    ScenarioParams,
    DashboardParams,
    ConsumptionParams,
)

__all__ = [
    "HistoryParams",
    "ForecastPeriodParams",
    "UsageParams",
    "BaselineParams",
    "ScenarioParams",
    "DashboardParams",
    "ConsumptionParams",
]
