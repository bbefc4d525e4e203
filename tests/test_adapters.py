"""The adapters reproduce the fact tables documented in FIXTURES.md."""

from pyspark.sql import functions as F

from meterwise import schemas
from meterwise.sources.adapters import account_monthly, usage_lines
from meterwise.sources.tables import SourceTables

SF = "/root/testdata/sf0.001"


def test_account_monthly_grain_and_counts(spark):
    fact = account_monthly(SourceTables(spark, SF))
    assert [(f.name, f.dataType) for f in fact.schema] == [
        (f.name, f.dataType) for f in schemas.ACCOUNT_MONTHLY]
    row = fact.agg(
        F.count("*").alias("rows"),
        F.countDistinct("account_id").alias("accounts"),
        F.countDistinct("account_id", "month").alias("grain"),
        F.sum(F.when(F.col("amount") == 0, 1).otherwise(0)).alias("zero"),
        F.sum(F.when(F.col("submitted_forecast").isNull(), 1).otherwise(0)).alias("no_submitted"),
        F.sum(F.when(F.dayofmonth("month") != 1, 1).otherwise(0)).alias("not_first"),
    ).first()
    assert (row.rows, row.accounts, row.grain, row.zero, row.no_submitted, row.not_first) == (
        1387, 150, 1387, 70, 280, 0)


def test_usage_lines_counts(spark):
    fact = usage_lines(SourceTables(spark, SF))
    assert fact.columns == schemas.USAGE_LINES.fieldNames()
    row = fact.agg(
        F.count("*").alias("rows"),
        F.countDistinct("sku_name").alias("skus"),
        F.countDistinct("workspace_id").alias("workspaces"),
        F.min("usage_date").alias("first"),
        F.max("usage_date").alias("last"),
    ).first()
    assert (row.rows, row.skus, row.workspaces) == (6000, 25, 10)
    assert str(row.first) == "1995-01-02" and str(row.last) <= "2001-11-04"


def test_usage_lines_column_subset_skips_lookups(spark):
    fact = usage_lines(SourceTables(spark, SF), columns=["account_id", "usage_date", "dollars"])
    text = fact._jdf.queryExecution().optimizedPlan().toString()
    assert fact.columns == ["account_id", "usage_date", "dollars"]
    assert "s_name" not in text and "p_brand" not in text
