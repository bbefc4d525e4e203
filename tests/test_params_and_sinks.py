"""Parameter validation (R5, R18, R19), limits, and the report writer."""

import math
import os
import tempfile
from datetime import date
from decimal import Decimal

import pytest

from meterwise.params import (
    HistoryParams,
    ScenarioParams,
    UsageParams,
    parse_limit,
    parse_min_growth,
)
from meterwise.sources.sinks import write_report


def test_min_growth_parsing():  # R18
    assert parse_min_growth("") is None
    assert parse_min_growth("  ") is None
    assert parse_min_growth("abc") is None
    assert parse_min_growth(" 5 ") == 5.0
    for bad in ("nan", "inf", "-inf", math.nan):
        with pytest.raises(ValueError):
            parse_min_growth(bad)


def test_limits_are_kept_or_refused():
    assert parse_limit(None) is None and HistoryParams().limit is None
    assert parse_limit(" 250 ") == 250
    assert UsageParams("1", date(2020, 1, 1), date(2020, 2, 1), limit=5).limit == 5
    for bad in ("20000", 0, -1, "x", ""):
        with pytest.raises(ValueError):
            parse_limit(bad)
    with pytest.raises(ValueError):
        HistoryParams(limit=50000)


def test_no_limit_gives_the_whole_report(spark):
    from meterwise.plans.reports import history_report
    from tests.frames import account_monthly

    rows = [(a, f"n{a:05d}", date(2020, 1 + m, 1), 1) for a in range(950) for m in range(12)]
    fact = account_monthly(spark, rows)
    assert history_report(fact, HistoryParams("%", "2020-01-01", "2020-12-31")).count() == 11_400
    assert history_report(fact, HistoryParams("%", "2020-01-01", "2020-12-31", limit=7)).count() == 7


def test_checkpoint_dir_is_the_configured_one():
    from types import SimpleNamespace

    from meterwise.session import checkpoint_dir

    class Context:
        def __init__(self, master):
            self.master, self.set = master, None

        def getCheckpointDir(self):
            return self.set

        def getConf(self):
            return SimpleNamespace(get=lambda k, d: d)

        def setCheckpointDir(self, d):
            self.set = d

    def session(master, value):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: value or d), sparkContext=Context(master))

    given = session("spark://host:7077", "hdfs:///shared")
    assert checkpoint_dir(given) == "hdfs:///shared" == given.sparkContext.set
    assert checkpoint_dir(session("local[2]", "/preset")) == "/preset"
    assert os.path.isdir(checkpoint_dir(session("local[2]", None)))
    with pytest.raises(RuntimeError):
        checkpoint_dir(session("spark://host:7077", None))


def test_local_session_keeps_a_preset_folder():
    import subprocess
    import sys

    code = ("from pyspark.sql import SparkSession; from meterwise.session import local_session, checkpoint_dir; "
            "SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', '/tmp/preset-ckpt')"
            ".config('spark.ui.enabled', 'false').getOrCreate(); print(checkpoint_dir(local_session(1)))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().splitlines()[-1] == "/tmp/preset-ckpt", out.stderr[-2000:]


def test_blank_pattern_means_all():  # R5
    assert HistoryParams("  ").name_pattern == "%"
    assert HistoryParams(None).name_pattern == "%"


def test_dates_are_typed():  # R19
    assert HistoryParams("%", "2020-01-01", "2020-12-31").start == date(2020, 1, 1)
    with pytest.raises(ValueError):
        HistoryParams("%", "2020-13-01", "2020-12-31")


def test_growth_bounds():
    with pytest.raises(ValueError):
        ScenarioParams("1", date(2020, 12, 31), date(2021, 1, 1), date(2021, 12, 1),
                       (Decimal(501), Decimal(5), Decimal(5)))
    with pytest.raises(ValueError):
        UsageParams("  ", date(2020, 1, 1), date(2020, 2, 1))


def test_write_report_csv_and_parquet(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    out = tempfile.mkdtemp(prefix="meterwise-sink-")
    path = write_report(df, os.path.join(out, "csv"), "csv", single_file_rows=2)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["id", "name"] and back.count() == 2
    path = write_report(df, os.path.join(out, "pq"), "parquet")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        write_report(df, os.path.join(out, "x"), "xlsx")
    with pytest.raises(ValueError):
        write_report(df, os.path.join(out, "x"), single_file_rows=1_000_000)
    with pytest.raises(Exception, match="already exists"):
        write_report(df, path, "parquet")
    write_report(df.limit(1), path, "parquet", overwrite=True)
    assert spark.read.parquet(path).count() == 1


def test_consumption_params_share_pattern_and_limit():
    from meterwise.params import ConsumptionParams

    p = ConsumptionParams("  ", min_growth_pct="5", limit="200")
    h, f = p.history(), p.forecast()
    assert (h.name_pattern, f.name_pattern, h.limit, f.limit) == ("%", "%", 200, 200)
    assert (h.start, h.end, f.start, f.end) == (date(2024, 1, 1), date(2026, 1, 1),
                                                date(2025, 1, 1), date(2026, 6, 1))
    assert h.min_growth_pct == 5.0


def test_baseline_and_scenario_validation():
    from meterwise.params import BaselineParams

    with pytest.raises(ValueError):
        BaselineParams("1", date(2020, 12, 31), mode="median")
    with pytest.raises(ValueError):
        BaselineParams("1", date(2020, 12, 31), mode="latest_month")  # needs a start
    with pytest.raises(ValueError):
        ScenarioParams("1", date(2020, 12, 31), date(2021, 1, 1), date(2021, 12, 1),
                       (Decimal(5), Decimal(5)))  # three rates
    with pytest.raises(ValueError):
        ScenarioParams("1", date(2020, 12, 31), date(2021, 1, 1), date(2021, 12, 1),
                       (Decimal("NaN"), Decimal(5), Decimal(5)))
    p = ScenarioParams(" 7 ", "2020-12-31", "2021-01-01", "2021-12-01", (5.5, 10, "20"))
    assert p.account_id == "7" and p.growth_pct == (Decimal("5.5"), Decimal(10), Decimal(20))


def test_cli_rejects_bad_arguments():
    from meterwise import cli

    for argv in (["history"], ["usage", "--testdata", "/x"], ["scenario", "--testdata", "/x"],
                 ["history", "--testdata", "/x", "--table", "t"], ["nope"]):
        with pytest.raises(SystemExit) as e:
            cli.parser().parse_args(argv)
        assert e.value.code == 2


def test_compound_rule_needs_history_start(spark):
    from meterwise.plans.reports import scenario_report

    usage = spark.createDataFrame([], "account_id string, usage_date date, dollars decimal(18,4)")
    p = ScenarioParams("1", date(2020, 12, 31), date(2021, 1, 1), date(2021, 12, 1))
    with pytest.raises(ValueError):
        scenario_report(usage, p, "compound")
    with pytest.raises(ValueError):
        scenario_report(usage, p, "linear")


def test_an_empty_report_leaves_no_file(spark):
    out = tempfile.mkdtemp()
    some = spark.range(3).selectExpr("id AS x")
    for fmt in ("csv", "parquet", "json"):
        path = os.path.join(out, fmt)
        assert write_report(some.limit(0), path, fmt) is None
        assert os.listdir(out) == []
    path = os.path.join(out, "kept")
    assert write_report(some, path, "parquet") == path
    assert write_report(some.limit(0), path, "parquet", overwrite=True) is None
    assert spark.read.parquet(path).count() == 3  # what was there stays
    assert write_report(some.limit(0), path + "2", single_file_rows=5) is None
    assert os.listdir(out) == ["kept"]


def test_the_emptiness_of_a_report_needs_no_second_scan(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    path = os.path.join(tempfile.mkdtemp(), "r")
    write_report(spark.range(100).mapInArrow(count, "id long"), path, "csv")
    assert seen.value == 100


def test_a_failed_report_leaves_no_target(spark):
    path = os.path.join(tempfile.mkdtemp(), "r")
    with pytest.raises(Exception):
        write_report(spark.range(3).selectExpr("raise_error('no') AS x"), path, "csv")
    assert not os.path.exists(path)
