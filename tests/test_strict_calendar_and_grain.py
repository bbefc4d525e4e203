"""R3 previous calendar month, and the grain check of the previous-month window."""

from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meterwise.operators.windows import with_grain_checked, with_previous_amount
from meterwise.params import ForecastPeriodParams, HistoryParams
from meterwise.plans.catalog import QUERIES
from meterwise.plans.reports import forecast_period_report, history_report
from meterwise.sources.tables import read_account_monthly
from tests.frames import account_monthly, m

SF = "/root/testdata/sf0.001"


def history(strict=True, **kw):
    return HistoryParams("%", m(2023, 1), m(2025, 12), strict_calendar=strict, **kw)


def rows(df):
    return {(r["account_name"], r["month"]): (r["prev_amount"], r["mom_growth_pct"]) for r in df.collect()}


def test_gap_has_no_predecessor_under_the_calendar(spark):
    fact = account_monthly(spark, [(1, "A", m(2024, 1), 100), (1, "A", m(2024, 2), 110), (1, "A", m(2024, 4), 121),
                                   (1, "A", m(2024, 12), 10), (1, "A", m(2025, 1), 30), (2, "B", m(2024, 2), 7)])
    got = rows(history_report(fact, history()))
    assert got == {("A", m(2024, 1)): (None, None), ("A", m(2024, 2)): (100.0, 10.0), ("A", m(2024, 4)): (None, None),
                   ("A", m(2024, 12)): (None, None), ("A", m(2025, 1)): (10.0, 200.0), ("B", m(2024, 2)): (None, None)}
    by_row = rows(history_report(fact, history(False)))
    assert by_row[("A", m(2024, 4))] == (110.0, 10.0) and by_row[("A", m(2025, 1))] == (10.0, 200.0)


def test_hidden_and_null_months_still_precede(spark):
    fact = account_monthly(spark, [(1, "A", m(2024, 1), 0), (1, "A", m(2024, 2), 5), (1, "A", m(2024, 3), None),
                                   (1, "A", m(2024, 4), 6)])
    got = rows(history_report(fact, history()))
    assert got == {("A", m(2024, 2)): (0.0, None), ("A", m(2024, 4)): (None, None)}
    assert set(rows(history_report(fact, history(min_growth_pct=1)))) == set(got)  # NULL growth is kept


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 30), st.integers(0, 9)), unique_by=lambda r: r[:2], max_size=25))
def test_equals_a_lookup_of_the_month_before(spark, data):
    at = lambda k: date(2023 + k // 12, k % 12 + 1, 1)
    have = {(a, k): v for a, k, v in data}
    fact = account_monthly(spark, [(a, f"n{a}", at(k), v) for a, k, v in data])
    got = {(r["account_id"], r["month"]): r["prev_amount"]
           for r in with_previous_amount(fact, strict_calendar=True).collect()}
    want = {(a, at(k)): have.get((a, k - 1)) for a, k in have}
    assert got == {x: None if v is None else Decimal(v) for x, v in want.items()}


def test_one_window_in_either_form(spark):
    for key in ("history_mom", "history_strict_calendar"):
        plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert sum(line.lstrip(" :+-*(0123456789)").startswith("Window ") for line in plan.splitlines()) == 1, key


@pytest.mark.parametrize("strict", [False, True])
def test_a_second_row_of_a_month_fails_the_report(spark, strict):
    fact = account_monthly(spark, [(1, "A", m(2024, 1), 1), (1, "A", m(2024, 2), 2), (1, "A", m(2024, 2), 3)])
    with pytest.raises(Exception, match="more than one row for account_id 1 and month 2024-02-01"):
        history_report(fact, history(strict)).collect()


def test_reader_checks_the_grain_for_reports_without_a_window(spark, tmp_path):
    good = account_monthly(spark, [(1, "A", m(2024, 1), 1), (1, "A", m(2024, 2), 2), (2, "B", m(2024, 2), 3)])
    bad = good.union(good.limit(1))
    p = ForecastPeriodParams("%", m(2024, 1), m(2024, 12))
    good.write.parquet(str(tmp_path / "good"))
    bad.write.parquet(str(tmp_path / "bad"))
    assert forecast_period_report(read_account_monthly(spark, str(tmp_path / "good"), check_grain=True), p).count() == 3
    assert forecast_period_report(read_account_monthly(spark, str(tmp_path / "bad")), p).count() == 4
    with pytest.raises(Exception, match="more than one row"):
        forecast_period_report(read_account_monthly(spark, str(tmp_path / "bad"), check_grain=True), p).collect()
    assert with_grain_checked(good).columns == good.columns
