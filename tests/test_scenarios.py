"""P4 / P5 rule cases (R10-R14, R16, R20) and cross-rule properties."""

from datetime import date, datetime
from decimal import Decimal

from meterwise.functions.growth import compound_multipliers, flat_multipliers
from meterwise.params import BaselineParams, ScenarioParams, UsageParams
from meterwise.plans.reports import (
    baseline_report,
    scenario_report,
    usage_report,
    year_bucket_report,
)
from tests.frames import m, usage_lines

RATES = (Decimal(5), Decimal(10), Decimal(20))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]["baseline_dollars"]


def test_baseline_modes(spark):  # R10
    usage = usage_lines(spark, [("1", m(2020, 11, 5), 10), ("1", m(2020, 12, 5), 20)])
    end = date(2020, 12, 31)
    assert one(baseline_report(usage, BaselineParams("1", end))) == 30.0
    assert one(baseline_report(usage, BaselineParams("1", end, "latest_month", start=m(2020, 1)))) == 20.0


def test_empty_and_zero_baseline(spark):  # R10, R20
    end = date(2020, 12, 31)
    empty = usage_lines(spark, [])
    zero = usage_lines(spark, [("1", m(2020, 12, 5), 0)])
    assert one(baseline_report(empty, BaselineParams("1", end, default=0))) == 0.0
    assert one(baseline_report(empty, BaselineParams("1", end, default=1))) == 1.0
    assert one(baseline_report(zero, BaselineParams("1", end, default=1))) == 0.0
    latest = BaselineParams("1", end, "latest_month", start=m(2020, 1))
    assert one(baseline_report(empty, latest)) == 1.0
    assert one(baseline_report(zero, latest)) == 1.0


def test_all_accounts_keep_accounts_without_window_usage(spark):  # R20
    usage = usage_lines(spark, [("1", m(2020, 12, 5), 7), ("2", m(2019, 1, 5), 9)])
    end = date(2020, 12, 31)
    out = {r["account_id"]: r["baseline_dollars"]
           for r in baseline_report(usage, BaselineParams(None, end, default=1)).collect()}
    assert out == {"1": 7.0, "2": 1.0}
    out = {r["account_id"]: r["baseline_dollars"] for r in baseline_report(
        usage, BaselineParams(None, end, "latest_month", start=m(2020, 1))).collect()}
    assert out == {"1": 7.0, "2": 1.0}


def test_reversed_range_gives_no_rows(spark):  # R11
    usage = usage_lines(spark, [("1", m(2020, 12, 5), 7)])
    for rule in ("flat", "compound"):
        p = ScenarioParams("1", date(2020, 12, 31), m(2022, 1), m(2021, 1), RATES,
                           history_start=m(2020, 1))
        assert scenario_report(usage, p, rule).count() == 0


def test_mid_month_start(spark):  # R12
    usage = usage_lines(spark, [("1", m(2020, 12, 5), 7)])
    p = ScenarioParams("1", date(2020, 12, 31), date(2021, 1, 15), m(2021, 12), RATES,
                       history_start=m(2020, 1))
    flat = scenario_report(usage, p, "flat").collect()
    comp = scenario_report(usage, p, "compound").collect()
    assert len(flat) == 12 and flat[0]["month"] == m(2021, 1)
    assert len(comp) == 11 and comp[0]["month"] == m(2021, 2)
    assert {r["year_bucket"] for r in comp} == {"Yr1"}


def test_years_four_and_five_multipliers():  # R13
    flat = flat_multipliers(RATES, 5)
    comp = compound_multipliers(RATES, 5, Decimal(5))
    assert flat[3] == flat[4] == Decimal("1.386")
    assert comp[3] == Decimal("1.6632") and comp[4] == Decimal("1.74636")
    assert flat[:3] == comp[:3] == [Decimal("1.05"), Decimal("1.155"), Decimal("1.386")]


def test_years_four_and_five_projected(spark):  # R13, R14
    usage = usage_lines(spark, [("1", m(2020, 12, 5), 100000)])
    p = ScenarioParams("1", date(2020, 12, 31), m(2021, 1), m(2025, 12), RATES,
                       history_start=m(2020, 1))
    flat = scenario_report(usage, p, "flat").collect()
    comp = scenario_report(usage, p, "compound").collect()
    assert len(flat) == len(comp) == 60
    by_year_flat = {r["year_bucket"]: set() for r in flat}
    for r in flat:
        by_year_flat[r["year_bucket"]].add(r["projected_usage_dollars"])
    assert by_year_flat == {"Yr1": {105000.0}, "Yr2": {115500.0}, "Yr3": {138600.0},
                            "Yr4": {138600.0}, "Yr5": {138600.0}}
    by_year_comp = {r["year_bucket"]: r["projected_usage_dollars"] for r in comp}
    assert by_year_comp["Yr4"] == 166320.0 and by_year_comp["Yr5"] == 174636.0
    assert {r["organic_growth_pct"] for r in comp if r["year_bucket"] in ("Yr3", "Yr4", "Yr5")} == {20.0}


def test_last_day_timestamp_kept(spark):  # R16
    usage = usage_lines(spark, [("1", datetime(2020, 12, 31, 5, 0), 10)])
    assert usage_report(usage, UsageParams("1", m(2020, 12), date(2020, 12, 31))).count() == 1
    assert one(baseline_report(usage, BaselineParams("1", date(2020, 12, 31)))) == 10.0


def test_flat_equals_compound_within_three_years(spark):  # cross-rule property
    usage = usage_lines(spark, [("1", m(2020, 12, 5), "1234.5678"), ("2", m(2020, 12, 30), "99.99")])
    p = ScenarioParams(None, date(2020, 12, 31), m(2021, 1), m(2023, 12), RATES,
                       history_start=m(2020, 12))
    key = ["account_id", "month"]
    flat = {tuple(r[k] for k in key): r["projected_usage_dollars"]
            for r in scenario_report(usage, p, "flat").collect()}
    comp = {tuple(r[k] for k in key): r["projected_usage_dollars"]
            for r in scenario_report(usage, p, "compound").collect()}
    assert flat.keys() == comp.keys() and len(flat) == 72
    assert all(abs(flat[k] - comp[k]) <= 0.01 for k in flat)


def test_batch_equals_single_account(spark):  # R20
    usage = usage_lines(spark, [("1", m(2020, 12, 5), 10), ("1", m(2020, 11, 5), 5),
                                ("2", m(2020, 6, 5), 3), ("3", m(2020, 12, 31), 0)])
    base = dict(history_end=date(2020, 12, 31), forecast_start=m(2021, 1),
                forecast_end=m(2022, 6), growth_pct=RATES, history_start=m(2020, 1))
    for rule in ("flat", "compound"):
        batch = scenario_report(usage, ScenarioParams(None, **base), rule)
        for acct in ("1", "2", "3", "404"):
            single = scenario_report(usage, ScenarioParams(acct, **base), rule).collect()
            expect = sorted(tuple(r) for r in batch.filter(batch.account_id == acct)
                            .drop("account_id").collect())
            if acct == "404":  # unknown account: single form projects from the default
                assert len(single) == 18 and not expect
            else:
                assert sorted(tuple(r) for r in single) == expect


def test_year_bucket_totals(spark):  # R14
    usage = usage_lines(spark, [("1", m(2020, 12, 5), 1), ("1", m(2021, 1, 20), 2), ("2", m(2021, 2, 1), 3),
                                ("1", m(2021, 12, 31), 4), ("1", m(2022, 1, 1), 5), ("3", m(2021, 2, 3), "0.5")])
    out = {tuple(r) for r in year_bucket_report(usage, date(2021, 1, 15)).collect()}
    # January 2021 starts before the raw forecast start, but its year counts from it
    assert out == {(None, "Historical", 2, 3.0), (1, "Yr1", 2, 7.5), (2, "Yr2", 1, 5.0)}


def test_projection_rounds_the_exact_product(spark):  # R7
    # 96051.6432 * 1.833678 = 176127.7849996896: just under the half cent.
    usage = usage_lines(spark, [("1", m(2000, 12, 5), "96051.6432")])
    p = ScenarioParams("1", date(2000, 12, 31), m(2001, 1), m(2006, 12), RATES,
                       history_start=m(2000, 1))
    yr6 = [r for r in scenario_report(usage, p, "compound").collect() if r["year_bucket"] == "Yr6"]
    assert {r["projected_usage_dollars"] for r in yr6} == {176127.78}


def test_usage_report_is_not_grouped(spark):  # R9
    usage = usage_lines(spark, [("1", m(2020, 12, 5), 10), ("1", m(2020, 12, 6), 10),
                                ("1", m(2020, 11, 5), 3)])
    out = usage_report(usage, UsageParams("1", m(2020, 1), date(2020, 12, 31))).collect()
    assert [(r["month"], r["dollars"]) for r in out] == [
        (m(2020, 12), 10.0), (m(2020, 12), 10.0), (m(2020, 11), 3.0)]


def test_dashboard_params_feed_both_reports(spark):  # R17
    from meterwise.params import DashboardParams
    from meterwise.plans.reports import dashboard

    p = DashboardParams.for_today("1", date(2020, 12, 15), growth_pct=RATES)
    assert (p.history_start, p.forecast_start, p.forecast_end) == (
        date(2019, 12, 15), date(2021, 1, 15), date(2023, 12, 15))
    usage = usage_lines(spark, [("1", m(2020, 12, 5), 10), ("2", m(2020, 12, 5), 99)])
    lines, scenario = dashboard(usage, p)
    assert [r["dollars"] for r in lines.collect()] == [10.0]
    rows = scenario.collect()
    assert len(rows) == 35 and rows[0]["month"] == m(2021, 2)  # mid-month start: loop rule drops it
    assert rows[0]["projected_usage_dollars"] == 10.5
