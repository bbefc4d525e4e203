"""What one task of the fact writers takes, whatever the size of the tables."""

import re
import tempfile

from pyspark.sql import functions as F

from meterwise.plans import facts as facts_module
from meterwise.plans.facts import compact_facts, read_facts, write_facts
from meterwise.sources.adapters import order_lines
from meterwise.sources.tables import SourceTables

SF = "/root/testdata/sf0.001"
ROWS = 1000


def folder():
    return tempfile.mkdtemp(prefix="meterwise-sizes-") + "/facts"


def test_usage_ranges_follow_the_number_of_lines(spark, monkeypatch):
    ranges, write = [], facts_module._write_months

    def noted(df, path, month):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        ranges.extend(int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan))
        return write(df, path, month)

    monkeypatch.setattr(facts_module, "_write_months", noted)
    monkeypatch.setattr(facts_module, "USAGE_ROWS", ROWS)
    paths = write_facts(spark, SourceTables(spark, SF), folder())
    again = compact_facts(spark, paths, folder())
    lines = read_facts(spark, paths).usage.count()
    assert ranges == [-(-lines // ROWS)] * 2
    for p in (paths, again):
        per_task = (spark.read.parquet(p.usage_lines).groupBy(F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1))
                    .count().agg(F.max("count")).first()[0])
        assert per_task <= 2 * ROWS  # ranges are sampled


def test_lines_meet_the_parts_before_their_orders(spark):
    """So that the lines of an order lie together where fact A sums them."""
    plan = order_lines(SourceTables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join \w+, \((\w+)#", plan)  # the last one first
    assert joins.index("l_orderkey") < joins.index("l_partkey")
