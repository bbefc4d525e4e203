"""Spark reports against brute-force Python versions of the rules.

The brute-force side restates each rule as a plain loop over Python lists
(exact ``Decimal`` money, half-up rounding); hypothesis draws small random
tables and parameters.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meterwise.params import BaselineParams, HistoryParams, ScenarioParams
from meterwise.plans.reports import baseline_report, history_report, scenario_report
from tests.frames import account_monthly, usage_lines

CENT = Decimal("0.01")
SETTINGS = settings(max_examples=20, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def r2(x: Decimal) -> float:
    return float(x.quantize(CENT, ROUND_HALF_UP))


def month_add(d: date, n: int) -> date:
    i = d.year * 12 + d.month - 1 + n
    return date(i // 12, i % 12 + 1, 1)


def like(name, pattern) -> bool:
    if name is None:
        return False
    rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return re.fullmatch(rx, name, flags=re.IGNORECASE | re.DOTALL) is not None


money = st.decimals(min_value=0, max_value=5000, places=2, allow_nan=False, allow_infinity=False)
months = st.integers(0, 17).map(lambda k: month_add(date(2020, 1, 1), k))


@st.composite
def monthly_tables(draw):
    rows, seen = [], set()
    for _ in range(draw(st.integers(1, 25))):
        acct = draw(st.integers(1, 4))
        m = draw(months)
        if (acct, m) in seen:
            continue
        seen.add((acct, m))
        name = {1: "alpha", 2: "Beta", 3: None, 4: "alphabet"}[acct]
        amount = draw(st.one_of(st.just(Decimal(0)), money))
        rows.append((acct, name, m, amount))
    return rows


@SETTINGS
@given(rows=monthly_tables(), pattern=st.sampled_from(["%", "%alpha%", "b%", "_lpha"]),
       lo=st.integers(0, 8), span=st.integers(0, 12), min_growth=st.sampled_from([None, 0.0, 5.0, -50.0]),
       limit=st.integers(1, 30))
def test_history_matches_brute_force(spark, rows, pattern, lo, span, min_growth, limit):
    start, end = month_add(date(2020, 1, 1), lo), month_add(date(2020, 1, 1), lo + span)
    scoped = [r for r in rows if like(r[1], pattern) and start <= r[2] <= end]
    by_acct = defaultdict(list)
    for r in scoped:
        by_acct[r[0]].append(r)
    shown = []
    for acct, rs in by_acct.items():
        rs.sort(key=lambda r: r[2])
        prev = None
        for r in rs:
            pct = None
            if prev is not None and prev > 0:
                pct = float(r[3] - prev) / float(prev) * 100.0
            if r[3] > 0 and (min_growth is None or pct is None or pct >= min_growth):
                shown.append((r[1], r[2], acct, r2(r[3]), None if prev is None else r2(prev), pct))
            prev = r[3]
    shown.sort(key=lambda t: (t[0], -t[1].toordinal(), t[2]))
    expect = shown[:limit]

    fact = account_monthly(spark, rows)
    got = history_report(fact, HistoryParams(pattern, start, end, min_growth, limit)).collect()
    assert len(got) == len(expect)
    for g, e in zip(got, expect):
        assert (g["account_name"], g["month"], g["amount"], g["prev_amount"]) == (e[0], e[1], e[3], e[4])
        if e[5] is None:
            assert g["mom_growth_pct"] is None
        else:
            assert abs(g["mom_growth_pct"] - e[5]) <= 0.005 + 1e-9


@st.composite
def usage_tables(draw):
    rows = []
    for _ in range(draw(st.integers(0, 20))):
        acct = draw(st.sampled_from(["1", "2", "3"]))
        day = date(2020, 9, 1) + timedelta(days=draw(st.integers(0, 150)))
        rows.append((acct, day, draw(st.one_of(st.just(Decimal(0)), money))))
    return rows


def brute_trailing(rows, acct, end, default):
    lo = month_add(date(end.year, end.month, 1), -1)
    vals = [d for a, day, d in rows if a == acct and lo <= day <= end]
    return sum(vals, Decimal(0)) if vals else default


def brute_latest(rows, acct, start, end):
    totals = defaultdict(Decimal)
    for a, day, d in rows:
        if a == acct and start <= day <= end:
            totals[date(day.year, day.month, 1)] += d
    if not totals:
        return Decimal(1)
    t = totals[max(totals)]
    return Decimal(1) if t == 0 else t


def month_range(fs, fe):
    """First days of the months of a forecast; empty for a reversed range."""
    n = (fe.year - fs.year) * 12 + fe.month - fs.month
    return [month_add(date(fs.year, fs.month, 1), k) for k in range(n + 1)]


def grown(pcts):
    return math.prod((1 + p / 100 for p in pcts), start=Decimal(1))


def brute_flat(base, fs, fe, rates):
    """R13, flat: the rates of the years so far, the third's being the last."""
    return [(m, f"Yr{y}", r2(rates[min(y, 3) - 1]), r2(base * grown(rates[:y])))
            for k, m in enumerate(month_range(fs, fe)) for y in [k // 12 + 1]]


def brute_compound(base, fs, fe, rates):
    """R13, compound: all earlier years (5 % each after the third) times the
    year's own rate; R12: a month that starts before the raw date is dropped."""
    def row(m, y):
        own = rates[min(y, 3) - 1]
        earlier = [*rates, *[Decimal(5)] * y][:y - 1]
        return m, f"Yr{y}", r2(own), r2(base * grown(earlier) * grown([own]))

    return [row(m, k // 12 + 1) for k, m in enumerate(month_range(fs, fe)) if m >= fs]


rates_st = st.tuples(*[st.sampled_from([Decimal(x) for x in ("0", "5", "7.5", "10", "-20", "100")])] * 3)


@SETTINGS
@given(rows=usage_tables(), fs_day=st.integers(0, 400), months_n=st.integers(-3, 75), rates=rates_st,
       rule=st.sampled_from(["flat", "compound"]))
def test_scenarios_match_brute_force(spark, rows, fs_day, months_n, rates, rule):
    end = date(2020, 12, 31)
    start = date(2020, 6, 1)
    fs = date(2021, 1, 1) + timedelta(days=fs_day)
    fe = month_add(date(fs.year, fs.month, 1), months_n)
    usage = usage_lines(spark, rows)
    p_all = ScenarioParams(None, end, fs, fe, rates, history_start=start)
    got = defaultdict(list)
    for r in scenario_report(usage, p_all, rule).collect():
        got[r["account_id"]].append((r["month"], r["year_bucket"], r["organic_growth_pct"],
                                     r["projected_usage_dollars"]))
    for acct in {a for a, _, _ in rows}:
        if rule == "flat":
            expect = brute_flat(brute_trailing(rows, acct, end, Decimal(1)), fs, fe, rates)
        else:
            expect = brute_compound(brute_latest(rows, acct, start, end), fs, fe, rates)
        assert sorted(got[acct]) == expect


@SETTINGS
@given(rows=usage_tables(), end_day=st.integers(0, 150))
def test_baselines_match_brute_force(spark, rows, end_day):
    end = date(2020, 9, 1) + timedelta(days=end_day)
    start = date(2020, 9, 15)
    usage = usage_lines(spark, rows)
    trailing = {r["account_id"]: r["baseline_dollars"]
                for r in baseline_report(usage, BaselineParams(None, end, default=0)).collect()}
    latest = {r["account_id"]: r["baseline_dollars"] for r in baseline_report(
        usage, BaselineParams(None, end, "latest_month", start=start)).collect()}
    accounts = {a for a, _, _ in rows}
    assert set(trailing) == set(latest) == accounts
    for acct in accounts:
        assert trailing[acct] == float(brute_trailing(rows, acct, end, Decimal(0)))
        assert latest[acct] == float(brute_latest(rows, acct, start, end))


@SETTINGS
@given(rows=monthly_tables(), pattern=st.sampled_from(["%", "%ALPHA%", "beta"]),
       lo=st.integers(0, 8), span=st.integers(-2, 12), limit=st.integers(1, 30))
def test_forecast_period_matches_brute_force(spark, rows, pattern, lo, span, limit):
    from meterwise.params import ForecastPeriodParams
    from meterwise.plans.reports import forecast_period_report

    start, end = month_add(date(2020, 1, 1), lo), month_add(date(2020, 1, 1), lo + span)
    keep = [r for r in rows if like(r[1], pattern) and start <= r[2] <= end]
    keep.sort(key=lambda r: (r[1], r[2], r[0]))
    expect = [(r[1], r[2], r2(r[3])) for r in keep[:limit]]
    got = forecast_period_report(account_monthly(spark, rows),
                                 ForecastPeriodParams(pattern, start, end, limit)).collect()
    assert [(g["account_name"], g["month"], g["amount"]) for g in got] == expect


@SETTINGS
@given(rows=usage_tables(), acct=st.sampled_from(["1", "2", "9"]), lo=st.integers(0, 100),
       span=st.integers(0, 80), limit=st.integers(1, 30))
def test_usage_report_and_totals_match_brute_force(spark, rows, acct, lo, span, limit):
    from meterwise.params import UsageParams
    from meterwise.plans.reports import usage_report, usage_totals

    start = date(2020, 9, 1) + timedelta(days=lo)
    end = start + timedelta(days=span)
    keep = [r for r in rows if r[0] == acct and start <= r[1] <= end]
    month = lambda d: date(d.year, d.month, 1)
    expect = sorted(((month(r[1]), float(r[2])) for r in keep), key=lambda t: (-t[0].toordinal(), -t[1]))
    usage = usage_lines(spark, rows)
    got = usage_report(usage, UsageParams(acct, start, end, limit)).collect()
    assert [(g["month"], g["dollars"]) for g in got] == expect[:limit]
    totals = defaultdict(Decimal)
    for r in keep:
        totals[month(r[1])] += r[2]
    got_t = {g["month"]: g["dollars"]
             for g in usage_totals(usage, UsageParams(acct, start, end, None), "month").collect()}
    assert got_t == {k: r2(v) for k, v in totals.items()}
