"""Intermediate tables in the shared folder.

A staged table is written once under ``spark.checkpoint.dir`` and read back:
later steps (the sampling job of a range partitioning, say) scan files instead
of running the joins behind them again, and a lost executor re-reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from meterwise.session import checkpoint_dir


def staged(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As ``staged``, with the number of rows, counted while writing."""
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]
