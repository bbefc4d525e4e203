"""Hot-key checks on data derived by Spark from the test tables.

1. Hot account: every third order re-keyed to customer 1, so one account owns
   a third of all orders and lines.
2. Hot order key: every third line re-keyed to order 0, so one key of the
   lines-to-orders sort-merge join holds a third of all lines. AQE splits
   such a partition along map-task boundaries; the test files are a single
   row group (one map task), so the lines are first spread round-robin over
   8 map tasks, as a multi-file table would be, and AQE's skew thresholds are
   scaled down to the test size (factor 2, 64 KB instead of 5x and 256 MB).

Runs all-accounts reports with the event log on (UI off) and prints, per
stage, the task count and the largest and median number of shuffle records
a task reads. A straggler would show as a max far above the median.

Usage: python tools/skew.py [sf_dir] [--json]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tools.stages import read_events  # noqa: E402

HOT_CUSTOMER = 1


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from meterwise.params import BaselineParams
    from meterwise.plans import catalog, reports
    from meterwise.sources.adapters import account_monthly, usage_lines
    from meterwise.sources.tables import SourceTables

    argv = [a for a in sys.argv[1:] if a != "--json"]
    as_json = "--json" in sys.argv[1:]
    folder = argv[0] if argv else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="meterwise-skew-")
    spark = (SparkSession.builder.master("local[8]").appName("meterwise-skew")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
             .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64k")
             .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", logdir)
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    tables = SourceTables(spark, folder)
    orders = tables("orders")
    tables.with_table("orders", orders.withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(HOT_CUSTOMER).cast("bigint"))
        .otherwise(F.col("o_custkey"))))
    share = (tables("orders").agg(F.avg((F.col("o_custkey") == HOT_CUSTOMER).cast("double"))).first()[0])

    hot_lines = SourceTables(spark, folder)
    hot_lines.with_table("lineitem", hot_lines("lineitem").repartition(8).withColumn(
        "l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, F.lit(0).cast("bigint"))
        .otherwise(F.col("l_orderkey"))))

    runs = {
        "fact A (account x month)": lambda: account_monthly(tables),
        "history_mom": lambda: reports.history_report(account_monthly(tables, months=(
            catalog.HISTORY_ALL.start, catalog.HISTORY_ALL.end)), catalog.HISTORY_ALL),
        "baseline_trailing_all": lambda: reports.baseline_report(
            usage_lines(tables, columns=list(catalog.BASE_COLUMNS)),
            BaselineParams(None, catalog.BASELINE_TRAILING_ALL.end)),
        "scenario_compound_all": lambda: reports.scenario_report(
            usage_lines(tables, columns=list(catalog.BASE_COLUMNS)), catalog.SCENARIO_COMPOUND_ALL,
            "compound"),
        "hot order key: baseline_trailing_all": lambda: reports.baseline_report(
            usage_lines(hot_lines, columns=list(catalog.BASE_COLUMNS)),
            BaselineParams(None, catalog.BASELINE_TRAILING_ALL.end)),
    }
    marks = []
    for name, build in runs.items():
        t0 = time.time() * 1000
        build().write.format("noop").mode("overwrite").save()
        marks.append((name, t0, time.time() * 1000))
    spark.stop()

    stages, reads = {}, {}
    for e in read_events(logdir):
        if e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Submission Time"], si["Number of Tasks"])
        elif e["Event"] == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            rec = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
            reads.setdefault(e["Stage ID"], []).append(rec)
    result = {"hot_share": share, "queries": {}}
    for name, start, end in marks:
        result["queries"][name] = [
            {"stage": sid, "tasks": n, "max": max(reads[sid]), "median": statistics.median(reads[sid]),
             "total": sum(reads[sid])}
            for sid, (sub, n) in sorted(stages.items())
            if start <= sub <= end and reads.get(sid) and max(reads[sid]) > 0]
    if as_json:
        print(json.dumps(result))
        return
    print(f"hot customer {HOT_CUSTOMER} owns {share:.1%} of all orders")
    for name, rows in result["queries"].items():
        print(f"== {name}")
        for r in rows:
            print(f"  stage {r['stage']:3d}  tasks {r['tasks']:3d}  shuffle records per task: "
                  f"max {r['max']:7d}  median {int(r['median']):7d}  total {r['total']:8d}")

if __name__ == "__main__":
    main()
