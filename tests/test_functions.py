"""Column helpers and parameter arithmetic."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from meterwise.functions.dates import (
    add_months,
    first_month_after,
    first_month_on_or_after,
    month_sequence,
    months_since,
    year_bucket,
    year_number,
)
from meterwise.functions.growth import by_year, compound_multipliers, flat_multipliers
from meterwise.functions.money import pct_change, round_money


def test_parameter_month_arithmetic():
    assert add_months(date(2020, 1, 31), 1) == date(2020, 2, 29)
    assert add_months(date(2021, 3, 31), -1) == date(2021, 2, 28)
    assert add_months(date(2020, 12, 15), 1) == date(2021, 1, 15)
    assert add_months(date(2020, 1, 1), -13) == date(2018, 12, 1)
    assert first_month_on_or_after(date(2020, 5, 1)) == date(2020, 5, 1)
    assert first_month_on_or_after(date(2020, 5, 2)) == date(2020, 6, 1)
    assert first_month_after(date(2020, 12, 31)) == date(2021, 1, 1)


def test_multipliers_edge_rates():
    assert flat_multipliers([Decimal(0)] * 3, 4) == [Decimal(1)] * 4
    assert flat_multipliers([Decimal(-100), Decimal(5), Decimal(5)], 2) == [Decimal(0), Decimal(0)]
    assert flat_multipliers([Decimal(900), Decimal(0), Decimal(0)], 1) == [Decimal(10)]
    comp = compound_multipliers([Decimal("7.5")] * 3, 6, Decimal(5))
    assert comp[0] == Decimal("1.075") and comp[2] == Decimal("1.075") ** 3
    assert comp[5] == Decimal("1.075") ** 4 * Decimal("1.05") ** 2
    assert all(m.as_tuple().exponent <= 0 for m in comp)


def test_date_columns(spark):
    df = spark.createDataFrame([(date(2021, 1, 1),), (date(2021, 12, 1),), (date(2022, 1, 1),),
                                (date(2024, 3, 1),)], "month date")
    fs = date(2021, 1, 15)
    out = df.select(
        "month",
        months_since("month", F.lit(fs)).alias("d"),
        year_number("month", F.lit(date(2021, 1, 1))).alias("yr"),
        year_bucket("month", F.lit(fs)).alias("b"),
    ).collect()
    assert [(r.d, r.yr, r.b) for r in out] == [
        (0, 1, "Historical"), (11, 1, "Yr1"), (12, 2, "Yr2"), (38, 4, "Yr4")]


def test_month_sequence_columns(spark):
    df = spark.createDataFrame([(date(2021, 1, 20), date(2021, 3, 2)), (date(2021, 3, 2), date(2021, 1, 20)),
                                (date(2021, 5, 5), date(2021, 5, 30))], "a date, b date")
    out = [r.s for r in df.select(month_sequence(F.col("a"), F.col("b")).alias("s")).collect()]
    assert out == [[date(2021, 1, 1), date(2021, 2, 1), date(2021, 3, 1)], [], [date(2021, 5, 1)]]


def test_money_helpers(spark):
    df = spark.createDataFrame([(Decimal("110.0000"), Decimal("100.0000")),
                                (Decimal("5.0000"), Decimal("0.0000")),
                                (Decimal("5.0000"), None),
                                (Decimal("-2.5050"), Decimal("-1.0000"))],
                               "cur decimal(38,4), prev decimal(38,4)")
    out = df.select(pct_change("cur", "prev").alias("p"), round_money("cur").alias("r")).collect()
    assert [(r.p, r.r) for r in out] == [(10.0, 110.0), (None, 5.0), (None, 5.0), (None, -2.51)]


def test_by_year_case(spark):
    df = spark.range(1, 6).select(F.col("id").cast("int").alias("yr"))
    vals = [Decimal("1.05"), Decimal("1.155"), Decimal("1.386")]
    out = [r.v for r in df.select(by_year(F.col("yr"), vals).alias("v")).orderBy("yr").collect()]
    assert out == [Decimal("1.050"), Decimal("1.155"), Decimal("1.386"), Decimal("1.386"), Decimal("1.386")]
