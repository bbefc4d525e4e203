"""Typed report parameters.

Parameters become typed Column literals; nothing is spliced into SQL text, so
quotes and backslashes in a name pattern need no escaping by the caller.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

# Fixed values of the reports (bounds and defaults of the original front ends).
# Top-k sizes the front ends offer by default, and the largest they accept.
HISTORY_LIMIT_DEFAULT = 500
USAGE_LIMIT_DEFAULT = 1000
LIMIT_MAX = 10000
GROWTH_PCT_MIN = Decimal("-100")
GROWTH_PCT_MAX = Decimal("500")
GROWTH_PCT_DEFAULT = Decimal("5")
# Rate carried into the compound factor for years after the third (loop rule).
COMPOUND_CARRY_PCT = Decimal("5")
# Trailing-baseline fallbacks: the baseline dataset uses 0, the scenario 1.
TRAILING_DEFAULT_BASELINE = Decimal("0")
SCENARIO_DEFAULT_BASELINE = Decimal("1")
# Latest-month baseline: a total of 0 (or no rows) becomes this placeholder.
LATEST_MONTH_ZERO_PLACEHOLDER = Decimal("1")


def parse_limit(value) -> int | None:
    """Rows of a top-k report, 1 to ``LIMIT_MAX``; ``None`` means the whole
    report. Anything else raises: a limit is never changed silently."""
    if value is None:
        return None
    try:
        n = int(str(value).strip())
    except ValueError:
        raise ValueError(f"limit must be a whole number or None, got {value!r}") from None
    if not 1 <= n <= LIMIT_MAX:
        raise ValueError(f"limit must be within 1..{LIMIT_MAX} or None for all rows, got {value!r}")
    return n


def parse_min_growth(text) -> float | None:
    """Optional minimum MoM growth.

    Blank or unparsable text means "no filter". A non-finite number is
    rejected, since ``NaN >= x`` is true in Spark and would keep every row.
    """
    if text is None:
        return None
    if isinstance(text, (int, float, Decimal)):
        value = float(text)
    else:
        s = str(text).strip()
        if not s:
            return None
        try:
            value = float(s)
        except ValueError:
            return None
    if not math.isfinite(value):
        raise ValueError(f"minimum growth must be finite, got {text!r}")
    return value


def normalize_pattern(pattern: str | None) -> str:
    """Case-insensitive LIKE pattern; blank means all (``%``)."""
    s = (pattern or "").strip()
    return s if s else "%"


def _as_date(d) -> date:
    if isinstance(d, date):
        return d
    return date.fromisoformat(str(d).strip())


def _pct(v) -> Decimal:
    d = Decimal(str(v))
    if not d.is_finite():
        raise ValueError(f"growth % must be finite, got {v!r}")
    if d < GROWTH_PCT_MIN or d > GROWTH_PCT_MAX:
        raise ValueError(f"growth % must be within {GROWTH_PCT_MIN}..{GROWTH_PCT_MAX}, got {v!r}")
    return d


@dataclass(frozen=True)
class HistoryParams:
    """Monthly history with month-over-month growth."""

    name_pattern: str = "%"
    start: date = date(2024, 1, 1)
    end: date = date(2026, 1, 1)
    min_growth_pct: float | None = None
    limit: int | None = None
    #: previous calendar month instead of the previous row
    strict_calendar: bool = False

    def __post_init__(self):
        object.__setattr__(self, "name_pattern", normalize_pattern(self.name_pattern))
        object.__setattr__(self, "start", _as_date(self.start))
        object.__setattr__(self, "end", _as_date(self.end))
        object.__setattr__(self, "min_growth_pct", parse_min_growth(self.min_growth_pct))
        object.__setattr__(self, "limit", parse_limit(self.limit))


@dataclass(frozen=True)
class ForecastPeriodParams:
    """Actual versus baseline and forecasts over a period."""

    name_pattern: str = "%"
    start: date = date(2025, 1, 1)
    end: date = date(2026, 6, 1)
    limit: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "name_pattern", normalize_pattern(self.name_pattern))
        object.__setattr__(self, "start", _as_date(self.start))
        object.__setattr__(self, "end", _as_date(self.end))
        object.__setattr__(self, "limit", parse_limit(self.limit))


@dataclass(frozen=True)
class UsageParams:
    """Usage lines of one account (or of all, ``account_id=None``)."""

    account_id: str | None
    start: date
    end: date
    limit: int | None = None

    def __post_init__(self):
        if self.account_id is not None:
            acct = str(self.account_id).strip()
            if not acct:
                raise ValueError("account id is required")
            object.__setattr__(self, "account_id", acct)
        object.__setattr__(self, "start", _as_date(self.start))
        object.__setattr__(self, "end", _as_date(self.end))
        object.__setattr__(self, "limit", parse_limit(self.limit))


@dataclass(frozen=True)
class BaselineParams:
    """Baseline of an account (or of all accounts, ``account_id=None``).

    ``mode`` is ``"trailing"`` (previous full month plus the end month to
    date, ``default`` when there are no rows) or ``"latest_month"`` (total of
    the latest month with usage in ``start..end``; 0 or no rows become 1).
    """

    account_id: str | None
    end: date
    mode: str = "trailing"
    default: Decimal = TRAILING_DEFAULT_BASELINE
    start: date | None = None

    def __post_init__(self):
        if self.account_id is not None:
            object.__setattr__(self, "account_id", str(self.account_id).strip())
        object.__setattr__(self, "end", _as_date(self.end))
        if self.start is not None:
            object.__setattr__(self, "start", _as_date(self.start))
        if self.mode not in ("trailing", "latest_month"):
            raise ValueError(f"unknown baseline mode {self.mode!r}")
        if self.mode == "latest_month" and self.start is None:
            raise ValueError("latest_month baseline needs a start date")
        object.__setattr__(self, "default", Decimal(str(self.default)))


@dataclass(frozen=True)
class ScenarioParams:
    """P5: projected usage by forecast month with yearly growth rates."""

    account_id: str | None
    history_end: date
    forecast_start: date
    forecast_end: date
    growth_pct: tuple = field(default=(GROWTH_PCT_DEFAULT,) * 3)
    history_start: date | None = None

    def __post_init__(self):
        if self.account_id is not None:
            object.__setattr__(self, "account_id", str(self.account_id).strip())
        for name in ("history_end", "forecast_start", "forecast_end"):
            object.__setattr__(self, name, _as_date(getattr(self, name)))
        if self.history_start is not None:
            object.__setattr__(self, "history_start", _as_date(self.history_start))
        rates = tuple(_pct(g) for g in self.growth_pct)
        if len(rates) != 3:
            raise ValueError("three yearly growth rates are required (Yr1, Yr2, Yr3)")
        object.__setattr__(self, "growth_pct", rates)


@dataclass(frozen=True)
class DashboardParams:
    """One parameter set for the usage report and the scenario together.

    The account and the history end drive both the usage report and the
    scenario baseline, so the two can never disagree. ``for_today`` gives the
    original front end's defaults: history = the last 12 months, forecast =
    next month through 35 months after it.
    """

    account_id: str
    history_start: date
    history_end: date
    forecast_start: date
    forecast_end: date
    growth_pct: tuple = field(default=(GROWTH_PCT_DEFAULT,) * 3)
    limit: int | None = USAGE_LIMIT_DEFAULT

    @classmethod
    def for_today(cls, account_id: str, today: date, **overrides) -> "DashboardParams":
        from meterwise.functions.dates import add_months

        fs = add_months(today, 1)
        values = dict(history_start=add_months(today, -12), history_end=today,
                      forecast_start=fs, forecast_end=add_months(fs, 35))
        values.update(overrides)
        return cls(account_id, **values)

    def usage(self) -> UsageParams:
        return UsageParams(self.account_id, self.history_start, self.history_end, self.limit)

    def scenario(self) -> ScenarioParams:
        return ScenarioParams(self.account_id, self.history_end, self.forecast_start,
                              self.forecast_end, self.growth_pct, self.history_start)


@dataclass(frozen=True)
class ConsumptionParams:
    """One parameter set for the monthly history and the forecast-period
    comparison, which share the name pattern and the row limit. Defaults are
    the original front end's."""

    name_pattern: str = "%"
    history_start: date = date(2024, 1, 1)
    history_end: date = date(2026, 1, 1)
    forecast_start: date = date(2025, 1, 1)
    forecast_end: date = date(2026, 6, 1)
    min_growth_pct: float | None = None
    limit: int | None = HISTORY_LIMIT_DEFAULT

    def history(self) -> HistoryParams:
        return HistoryParams(self.name_pattern, self.history_start, self.history_end,
                             self.min_growth_pct, self.limit)

    def forecast(self) -> ForecastPeriodParams:
        return ForecastPeriodParams(self.name_pattern, self.forecast_start, self.forecast_end, self.limit)
