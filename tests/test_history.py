"""P1 / P2 rule cases."""

from datetime import date

import pytest

from meterwise.params import ForecastPeriodParams, HistoryParams
from meterwise.plans.reports import forecast_period_report, history_report
from tests.frames import account_monthly, m


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_zero_month_hidden_but_is_predecessor(spark):  # R2
    fact = account_monthly(spark, [(1, "A", m(2020, 1), 100), (1, "A", m(2020, 2), 0),
                                   (1, "A", m(2020, 3), 50)])
    out = rows(history_report(fact, HistoryParams("%", m(2020, 1), m(2020, 12))))
    assert [r["month"] for r in out] == [m(2020, 3), m(2020, 1)]
    assert out[0]["prev_amount"] == 0.0 and out[0]["mom_growth_pct"] is None
    assert out[1]["prev_amount"] is None


def test_start_boundary_has_no_previous(spark):  # R1
    fact = account_monthly(spark, [(1, "A", m(2020, 1), 100), (1, "A", m(2020, 2), 110),
                                   (1, "A", m(2020, 3), 121)])
    out = rows(history_report(fact, HistoryParams("%", m(2020, 2), m(2020, 12))))
    assert [r["month"] for r in out] == [m(2020, 3), m(2020, 2)]
    assert out[-1]["prev_amount"] is None and out[-1]["mom_growth_pct"] is None
    assert out[0]["mom_growth_pct"] == 10.0


def test_gap_uses_previous_row(spark):  # R3
    fact = account_monthly(spark, [(1, "A", m(2020, 1), 100), (1, "A", m(2020, 3), 150)])
    out = rows(history_report(fact, HistoryParams("%", m(2020, 1), m(2020, 12))))
    assert out[0]["month"] == m(2020, 3) and out[0]["mom_growth_pct"] == 50.0


def test_threshold_keeps_null_growth(spark):  # R4
    fact = account_monthly(spark, [(1, "A", m(2020, 1), 100), (1, "A", m(2020, 2), 102),
                                   (1, "A", m(2020, 3), "109.14")])
    out = rows(history_report(fact, HistoryParams("%", m(2020, 1), m(2020, 12), min_growth_pct=5)))
    assert [(r["month"], r["mom_growth_pct"]) for r in out] == [(m(2020, 3), 7.0), (m(2020, 1), None)]


@pytest.mark.parametrize("pattern", ["%", "", "   "])
def test_null_name_never_matches(spark, pattern):  # R5
    fact = account_monthly(spark, [(1, None, m(2020, 1), 1), (2, "", m(2020, 1), 1),
                                   (3, "A", m(2020, 1), 1)])
    out = rows(history_report(fact, HistoryParams(pattern, m(2020, 1), m(2020, 12))))
    assert sorted(r["account_name"] for r in out) == ["", "A"]


def test_quote_in_pattern(spark):  # R6
    fact = account_monthly(spark, [(1, "O'Neil", m(2020, 1), 1), (2, "Other", m(2020, 1), 1)])
    out = rows(history_report(fact, HistoryParams("%o'n%", m(2020, 1), m(2020, 12))))
    assert [r["account_name"] for r in out] == ["O'Neil"]


def test_tie_at_limit_keeps_lower_account(spark):  # R8
    fact = account_monthly(spark, [(7, "Same", m(2020, 1), 70), (3, "Same", m(2020, 1), 30)])
    out = rows(history_report(fact, HistoryParams("%", m(2020, 1), m(2020, 12), limit=1)))
    assert [r["amount"] for r in out] == [30.0]
    out = rows(forecast_period_report(fact, ForecastPeriodParams("%", m(2020, 1), m(2020, 12), 1)))
    assert [r["amount"] for r in out] == [30.0]


def test_forecast_period_keeps_zero_actuals(spark):  # R15
    fact = account_monthly(spark, [(1, "A", m(2020, 1), 0, 5, 6, 7), (1, "A", m(2020, 2), 3, 5, 6, None)])
    out = rows(forecast_period_report(fact, ForecastPeriodParams("%", m(2020, 1), m(2020, 12))))
    assert [(r["month"], r["amount"], r["submitted_forecast"]) for r in out] == [
        (m(2020, 1), 0.0, 7.0), (m(2020, 2), 3.0, None)]


def test_rounding_is_half_up_on_decimals(spark):  # R7
    fact = account_monthly(spark, [(1, "A", m(2020, 1), "1.005", "2.675", "0.125", "-0.125")])
    out = rows(forecast_period_report(fact, ForecastPeriodParams("%", m(2020, 1), m(2020, 12))))[0]
    assert (out["amount"], out["baseline"], out["model_forecast"], out["submitted_forecast"]) == (
        1.01, 2.68, 0.13, -0.13)


def test_threshold_filters_unrounded_growth(spark):
    # 4.996 % rounds to 5.00 but is below the minimum of 5.
    fact = account_monthly(spark, [(1, "A", m(2020, 1), 100000), (1, "A", m(2020, 2), 104996)])
    out = rows(history_report(fact, HistoryParams("%", m(2020, 1), m(2020, 12), min_growth_pct=5)))
    assert [r["month"] for r in out] == [m(2020, 1)]


def test_history_order(spark):  # O1
    fact = account_monthly(spark, [(2, "b", m(2020, 1), 1), (1, "a", m(2020, 1), 1),
                                   (1, "a", m(2020, 2), 1)])
    out = rows(history_report(fact, HistoryParams("%", date(2020, 1, 1), date(2020, 12, 31))))
    assert [(r["account_name"], r["month"]) for r in out] == [
        ("a", m(2020, 2)), ("a", m(2020, 1)), ("b", m(2020, 1))]
