"""Facts made from lines that meet their orders once."""

import tempfile
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from meterwise.plans import catalog, facts as facts_module
from meterwise.plans.facts import read_facts, write_facts
from meterwise.sources.adapters import account_monthly, usage_lines, with_order_lines
from meterwise.sources.tables import SourceTables

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def folder():
    return tempfile.mkdtemp(prefix="meterwise-joined-") + "/facts"


class Counted(SourceTables):
    """Counts how often each table is asked for."""

    asked = Counter()

    def __call__(self, name):
        Counted.asked[name] += 1
        return super().__call__(name)


def odd_tables(spark):
    """Repeated, missing and null keys, null values, an open ship date."""
    lines = [(1, 1, 1, 1, 2.0, 10.0, 0.1, 0.05, "R", "O", "2000-01-05"), (1, 2, 2, 2, 1.0, 20.0, 0.0, 0.0, "N", "O", "2000-02-05"),
             (1, 9, 9, 3, 1.0, 30.0, 0.0, 0.1, None, "O", None), (2, None, None, 1, None, 40.0, None, None, "N", "O", "2000-03-05"),
             (None, 1, 1, 1, 1.0, 50.0, 0.0, 0.0, "N", "O", "2000-03-05"), (3, 1, 2, 1, 1.0, 60.0, 0.5, 0.0, "N", "O", "2000-03-05")]
    rows = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                                          "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                                          "l_returnflag string, l_linestatus string, d string")
        .withColumn("l_shipdate", F.col("d").cast("timestamp_ntz")).drop("d"),
        "orders": spark.createDataFrame([(1, 1, "2000-01-31 23:00:00"), (2, 2, "2000-02-01 00:00:00"), (2, 2, "2000-02-01 00:00:00"),
                                         (3, None, "2000-02-01 00:00:00"), (None, 1, "2000-02-01 00:00:00")],
                                        "o_orderkey long, o_custkey long, d string")
        .withColumn("o_orderdate", F.col("d").cast("timestamp_ntz")).drop("d"),
        "customer": spark.createDataFrame([(1, "A", 1, 0.0, "MACHINERY"), (2, "B", None, 0.0, None)], "c_custkey long, c_name string, "
                                          "c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": spark.createDataFrame([(1, "S1", 1, 0.0), (1, None, 1, 0.0), (2, "S2", 1, 0.0), (None, "S", 1, 0.0)],
                                          "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": spark.createDataFrame([(1, "B1"), (1, "B1"), (1, "B3"), (2, "B2")], "p_partkey long, p_brand string"),
    }
    tables = SourceTables(spark, SF)
    for name, df in rows.items():
        tables.with_table(name, df)
    return tables


@pytest.fixture(scope="module")
def written(spark):
    """Written facts, the plans of their writers and what was asked for."""
    plans, write = {}, facts_module._write_months

    def noted(df, path, month):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, path, month)

    tables = Counted(spark, SF)
    Counted.asked.clear()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(facts_module, "_write_months", noted)
        patch.setattr(facts_module, "MONTHLY_ROWS", 400)
        paths = write_facts(spark, tables, folder())
    return paths, plans, Counted.asked["lineitem"], tables


def test_both_facts_share_one_join(spark, written):
    paths, _, asked, tables = written
    assert asked == 1
    assert not tables.holds("order_lines")  # the caller's tables stay as they are
    facts, plain = read_facts(spark, paths), SourceTables(spark, SF)
    same(facts.monthly, account_monthly(plain).select(*facts.monthly.columns))
    same(facts.usage.drop("usage_month"), usage_lines(plain))


def test_a_refresh_shares_it_too(spark, monkeypatch):
    Counted.asked.clear()
    monkeypatch.setattr(catalog, "SourceTables", Counted)
    now = read_facts(spark, catalog.refreshed(spark, SF))
    assert Counted.asked["lineitem"] == 1
    plain = SourceTables(spark, SF)
    same(now.monthly, account_monthly(plain).select(*now.monthly.columns))
    same(now.usage.drop("usage_month"), usage_lines(plain))


def test_odd_rows_give_the_facts_of_the_joins(spark):
    plain = odd_tables(spark)
    joined = with_order_lines(plain)
    same(account_monthly(joined), account_monthly(plain))
    same(usage_lines(joined), usage_lines(plain))
    span = (date(2000, 1, 5), date(2000, 2, 5))
    same(usage_lines(joined, dates=span), usage_lines(plain, dates=span))
    same(usage_lines(joined, account_id="2"), usage_lines(plain, account_id="2"))
    months = (date(2000, 2, 1), date(2000, 2, 1))
    same(account_monthly(joined, months, "%b%"), account_monthly(plain, months, "%b%"))


def test_account_months_are_written_without_a_second_shuffle(spark, written):
    paths, plans, _, _ = written
    assert [n for n, p in sorted(plans.items()) if "RepartitionByExpression" in p] == ["usage_lines"]
    rows = spark.read.parquet(paths.account_monthly)
    files = rows.select("month", F.input_file_name().alias("f")).distinct().groupBy("month").count().collect()
    assert max(r["count"] for r in files) <= -(-rows.count() // 400)
