"""Written intermediate tables and size-checked broadcasts.

Intermediate results go to the folder that ``spark.checkpoint.dir`` names
(see ``meterwise.session.checkpoint_dir``), so a lost executor costs a re-read
and later joins see plain scans, whose skewed shuffle partitions AQE can split.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from meterwise.session import checkpoint_dir

#: Rows of narrow keys (a few longs each) up to which a side may be broadcast.
BROADCAST_ROWS = 2_000_000


def scratch_path(spark, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_with(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``materialize``, with aggregates (numbers) taken while writing."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), label)
    return out, seen.get


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    out, seen = materialize_with(df, label, n=F.count(F.lit(1)))
    return out, seen["n"]


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, known: int | None = None) -> DataFrame:
    """Mark narrow ``df`` for broadcast if its count (``known``, if taken
    before) is at most ``rows``; otherwise leave the join strategy to Spark
    (shuffle join)."""
    return F.broadcast(df) if (df.count() if known is None else known) <= rows else df


def fresh(name: str, taken) -> str:
    """A column name built on ``name`` that no column in ``taken`` has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
