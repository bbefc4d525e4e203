"""Written fact tables give the same reports as the on-the-fly adapters."""

import tempfile

import pytest
from pyspark.sql import functions as F

from meterwise.operators.filters import in_date_range
from meterwise.operators.windows import with_previous_amount
from meterwise.plans import catalog, reports
from meterwise.plans.facts import (
    fact_paths,
    read_facts,
    write_account_monthly_table,
    write_facts,
    write_usage_lines,
)
from meterwise.sources.adapters import account_monthly, usage_lines
from meterwise.sources.tables import SourceTables, read_account_monthly

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.fixture(scope="module")
def facts(spark):
    root = tempfile.mkdtemp(prefix="meterwise-facts-")
    return read_facts(spark, write_facts(spark, SourceTables(spark, SF), f"{root}/facts"))


def test_reports_on_written_facts(spark, facts):
    tables = SourceTables(spark, SF)
    assert facts.monthly.count() == account_monthly(tables).count()
    assert facts.usage.count() == usage_lines(tables).count()
    for key in ("history_min_growth", "usage_report", "scenario_compound_all", "baseline_trailing_all",
                "baseline_latest_month", "projected_by_month"):
        key = "history_mom_min_growth" if key == "history_min_growth" else key
        same(catalog.REGISTERED[key].on_facts(facts), catalog.QUERIES[key](spark, SF))


def test_served_date_ranges_prune_month_folders(spark, facts):
    for key in ("usage_report", "usage_by_month", "baseline_trailing", "baseline_trailing_all",
                "baseline_latest_month", "scenario_flat", "scenario_flat_all", "scenario_compound",
                "scenario_compound_all", "projected_by_month"):
        df = catalog.REGISTERED[key].on_facts(facts)
        plan = df._jdf.queryExecution().executedPlan().toString()
        if key in ("baseline_latest_month", "scenario_compound_all"):
            assert "usage_lines" not in plan, key  # from the month totals, see tests/test_served_facts.py
        else:
            assert "PartitionFilters: [isnotnull(usage_month" in plan, key
        if key.endswith("_all") or key == "baseline_latest_month":
            assert df.select("account_id").distinct().count() == 150, key


def test_usage_lines_lie_in_few_files_with_disjoint_accounts(spark, facts):
    per_file = (facts.usage.select("usage_month", "account_id", F.input_file_name().alias("file"))
                .groupBy("usage_month", "file").agg(F.min("account_id").alias("a"), F.max("account_id").alias("b"))
                .orderBy("usage_month", "a", "b").collect())
    months = len({r["usage_month"] for r in per_file})
    assert len(per_file) <= months + 8  # a range ends in a month, or a month in a range
    for x, y in zip(per_file, per_file[1:]):
        assert x["usage_month"] != y["usage_month"] or x["b"] <= y["a"]


def test_a_hot_account_splits_over_files(spark):
    one = usage_lines(SourceTables(spark, SF)).withColumn("account_id", F.lit("1")).withColumn(
        "usage_date", F.lit("2000-01-01").cast("date"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = write_usage_lines(one, tempfile.mkdtemp(prefix="meterwise-hot-") + "/u")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_two_writes_do_not_meet(spark):
    assert fact_paths(spark) != fact_paths(spark)
    with pytest.raises(ValueError):
        write_facts(spark, SourceTables(spark, SF), tempfile.mkdtemp() + "/f", monthly_table="t")


def test_bucketed_account_monthly_needs_no_shuffle_for_the_window(spark):
    tables = SourceTables(spark, SF)
    folder = tempfile.mkdtemp(prefix="meterwise-bucketed-") + "/t"
    table = write_account_monthly_table(account_monthly(tables), "meterwise_test_account_monthly", 4, folder)
    fact = read_account_monthly(spark, table)
    scoped = with_previous_amount(in_date_range(fact, catalog.HISTORY_ALL.start, catalog.HISTORY_ALL.end, "month"))
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan, plan
    same(reports.history_report(fact, catalog.HISTORY_MIN_GROWTH),
         reports.history_report(account_monthly(tables), catalog.HISTORY_MIN_GROWTH))
    spark.sql(f"DROP TABLE {table}")
