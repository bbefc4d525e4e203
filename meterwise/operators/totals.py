"""Chart totals (P6): one sum per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals_by(df: DataFrame, key: Column, value: str, name: str) -> DataFrame:
    """``groupBy(key).agg(sum(value))``; partial sums are combined map-side,
    so the shuffle carries one row per key per task."""
    return df.groupBy(key).agg(F.sum(value).alias(name))
