"""Facts as they are served: month totals, names, refreshed months, writers."""

import tempfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from meterwise.operators import names
from meterwise.operators.baselines import latest_month_baseline
from meterwise.operators.latest_month import _steps, latest_totals, month_totals
from meterwise.plans import catalog, facts as facts_module, reports
from meterwise.plans.facts import compact_facts, fact_paths, read_facts, refresh_facts, write_facts
from meterwise.sources import adapters
from meterwise.sources.tables import SourceTables
from tests.frames import m, usage_lines

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def folder():
    return tempfile.mkdtemp(prefix="meterwise-served-") + "/facts"


@pytest.fixture(scope="module")
def paths(spark):
    return write_facts(spark, SourceTables(spark, SF), folder())


@pytest.fixture(scope="module")
def facts(spark, paths):
    return read_facts(spark, paths)


def accounts_of(months):
    return months.groupBy("account_id").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def test_steps_cover_the_range_once_from_the_end():
    for start, end in ((m(2024, 1), m(2024, 12, 31)), (m(2024, 1, 5), m(2024, 12, 30)), (m(2024, 3, 5), m(2024, 3, 9)),
                       (m(2024, 2), m(2024, 2, 29)), (m(2020, 1), m(2024, 6, 30)), (m(2024, 1, 31), m(2024, 2, 1))):
        steps = list(_steps(start, end))
        days = [d for a, b, _ in steps for d in range(b.toordinal(), a.toordinal() - 1, -1)]
        assert days == list(range(end.toordinal(), start.toordinal() - 1, -1)), (start, end)
        for a, b, whole in steps:
            assert not whole or (a.day == 1 and date.fromordinal(b.toordinal() + 1).day == 1)
        assert len(steps) <= 9


def test_latest_month_stops_when_all_accounts_are_settled(spark):
    rows = [(f"a{i}", m(2024, 12, 5), i + 1) for i in range(5)] + [("a1", m(2020, 1), 9), ("old", m(2019, 12), 4),
                                                                   ("late", m(2025, 2), 4), ("b", m(2024, 11, 2), 3)]
    usage = usage_lines(spark, rows)
    months = month_totals(usage)
    seen = []
    got = latest_totals(usage, months, accounts_of(months), m(2020, 1), m(2024, 12, 31), seen=seen)
    assert {r[0]: float(r[1]) for r in got.collect()} == {"a0": 1, "a1": 2, "a2": 3, "a3": 4, "a4": 5, "b": 3}
    # accounts without a month in the range are not looked for
    assert seen == [(m(2024, 12), m(2024, 12, 31)), (m(2024, 10), m(2024, 11, 30))]
    with_list = latest_month_baseline(usage, m(2020, 1), m(2024, 12, 31), all_accounts=True,
                                      accounts=accounts_of(months), months=months)
    same(with_list, latest_month_baseline(usage, m(2020, 1), m(2024, 12, 31), all_accounts=True))


def test_months_cut_by_the_range_come_from_the_lines(spark):
    usage = usage_lines(spark, [("a", m(2024, 3, 5), 1), ("a", m(2024, 3, 20), 10), ("b", m(2024, 1, 5), 2),
                                ("b", m(2024, 1, 20), 20), ("c", m(2024, 3, 30), 5), ("c", m(2024, 2, 2), -3), ("c", m(2024, 2, 3), 3)])
    months = month_totals(usage)
    for start, end in ((m(2024, 1, 10), m(2024, 3, 10)), (m(2024, 3, 6), m(2024, 3, 19)), (m(2024, 1, 6), m(2024, 2, 29)),
                       (m(2024, 4), m(2024, 3)), (m(2023, 1), m(2023, 2))):
        a = latest_month_baseline(usage, start, end, all_accounts=True, accounts=accounts_of(months), months=months)
        same(a, latest_month_baseline(usage, start, end, all_accounts=True))


def test_served_latest_month_reads_few_months(spark, facts):
    seen = []
    p = catalog.BASELINE_LATEST_ALL
    latest_totals(facts.usage, facts.months, facts.accounts, p.start, p.end, seen=seen).collect()
    assert seen[0] == (m(2000, 12), m(2000, 12, 31)) and seen[-1][0] > p.start and len(seen) <= 6
    plan = facts.months.where((F.col("month") >= F.lit(seen[1][0])) & (F.col("month") <= F.lit(seen[1][1])))
    assert "PartitionFilters: [isnotnull(month" in plan._jdf.queryExecution().executedPlan().toString()
    same(catalog.REGISTERED["baseline_latest_month"].on_facts(facts), catalog.QUERIES["baseline_latest_month"](spark, SF))


def test_names_hold_each_pair_once(facts):
    assert facts.names.count() == facts.names.select("account_id").distinct().count() == facts.monthly.select(
        "account_id").distinct().count()


@pytest.mark.parametrize("pushed", [1000, 2])
def test_pattern_reaches_the_fact_scan_as_ids(spark, facts, monkeypatch, pushed):
    monkeypatch.setattr(names, "PUSHED_IDS", pushed)
    df = reports.history_report(facts.monthly, catalog.HISTORY_PATTERN, facts.names)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "amount" in x)
    if pushed == 1000:
        assert "In(account_id" in scan
    else:
        assert "LeftSemi" in plan
    same(df, catalog.QUERIES["history_name_pattern"](spark, SF))
    none = catalog.HistoryParams("no such name", m(1996, 1), m(2000, 12, 31))
    assert reports.history_report(facts.monthly, none, facts.names).count() == 0
    p = catalog.ForecastPeriodParams("%000001%", m(2000, 1), m(2001, 6))
    same(reports.forecast_period_report(facts.monthly, p, facts.names), reports.forecast_period_report(facts.monthly, p))


def test_many_ids_become_a_runtime_filter(spark, facts, monkeypatch):
    monkeypatch.setattr(names, "PUSHED_IDS", 2)
    conf = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = reports.history_report(facts.monthly, catalog.HISTORY_PATTERN, facts.names)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "might_contain" in plan


def test_a_changed_name_keeps_only_its_matching_months(spark):
    from tests.frames import account_monthly

    fact = account_monthly(spark, [(1, "Old", m(2024, 1), 1), (1, "New", m(2024, 2), 2), (2, "Older", m(2024, 1), 3)])
    dim = names.distinct_names(fact)
    got = names.accounts_named(fact, dim, "%old%").select("account_id", "month").collect()
    assert sorted(map(tuple, got)) == [(1, m(2024, 1)), (2, m(2024, 1))]


def files(spark, path, month):
    return {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}


def test_refresh_rewrites_only_its_months(spark):
    full = read_facts(spark, write_facts(spark, SourceTables(spark, SF), folder()))
    tables = SourceTables(spark, SF)
    late = F.col("o_orderdate") >= F.lit(date(2000, 11, 1))
    early = SourceTables(spark, SF).with_table("orders", tables("orders").where(~late))
    old = write_facts(spark, early, folder())
    before = files(spark, old.account_monthly, "month")
    root = folder()
    # November first, then December: a refresh on a refresh
    new = refresh_facts(spark, tables, old, monthly=(date(2000, 11, 9), date(2000, 11, 30)), root=root)
    written = {r[0] for r in spark.read.parquet(fact_paths(spark, root).account_monthly).select("month").distinct().collect()}
    assert written == {date(2000, 11, 1)}
    shipped = (tables("lineitem").join(tables("orders").where(late), F.col("l_orderkey") == F.col("o_orderkey"))
               .agg(F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date")).first())
    new = refresh_facts(spark, tables, new, monthly=(date(2000, 12, 1), date(2001, 12, 1)), usage=tuple(shipped), root=folder())
    now = read_facts(spark, new)
    assert files(spark, old.account_monthly, "month") == before  # older readers see no change
    same(now.monthly, full.monthly)
    same(now.usage, full.usage)
    same(now.months, full.months)
    same(now.accounts, full.accounts)
    same(now.names, full.names)
    for key in ("history_mom", "baseline_latest_month", "usage_by_month", "scenario_compound_own_growth"):
        same(catalog.REGISTERED[key].on_facts(now), catalog.REGISTERED[key].on_facts(full))
    plan = now.usage.where(F.col("usage_month") >= F.lit(date(2000, 12, 1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2
    whole = read_facts(spark, compact_facts(spark, new, folder()))
    same(whole.usage.drop("usage_month"), full.usage.drop("usage_month"))
    same(whole.monthly, full.monthly)


def test_a_refresh_can_be_run_again_and_can_empty_a_month(spark, paths):
    gone = SourceTables(spark, SF).with_table("orders", SourceTables(spark, SF)("orders").where("false"))
    root, month = folder(), date(2000, 5, 1)
    for _ in range(2):
        new = refresh_facts(spark, SourceTables(spark, SF), paths, monthly=(month, month), usage=(month, month), root=root)
    same(read_facts(spark, new).monthly, read_facts(spark, paths).monthly)
    same(read_facts(spark, new).usage, read_facts(spark, paths).usage)
    assert read_facts(spark, paths).usage.where(F.col("usage_month") == F.lit(month)).count() > 0
    cut = read_facts(spark, refresh_facts(spark, gone, paths, usage=(month, month), root=folder()))
    assert cut.usage.where(F.col("usage_month") == F.lit(month)).count() == 0
    assert cut.usage.count() + read_facts(spark, paths).usage.where(F.col("usage_month") == F.lit(month)).count() == \
        read_facts(spark, paths).usage.count()
    with pytest.raises(ValueError):
        refresh_facts(spark, gone, paths)


def test_writers_run_the_joins_once(spark, monkeypatch):
    """What is range-partitioned, and so sampled first, is a scan of files."""
    plans = []
    write = facts_module._write_months

    def noted(df, path, month):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, path, month)

    monkeypatch.setattr(facts_module, "_write_months", noted)
    write_facts(spark, SourceTables(spark, SF), folder())
    assert len(plans) == 3 and not any("Join" in p or "Aggregate" in p for p in plans)
    assert adapters.usage_lines(SourceTables(spark, SF)).count() > 0
