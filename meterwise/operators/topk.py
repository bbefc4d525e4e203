"""Sort + limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def top_rows(df: DataFrame, order: list[Column], limit: int | None,
             tie_breakers: list[Column] | None = None) -> DataFrame:
    """``orderBy(order + tie_breakers).limit(limit)``.

    The documented keys are not unique, so tie-breakers make the rows kept at
    the limit deterministic. With a limit Spark plans a top-k
    (``TakeOrderedAndProject``): each task keeps ``limit`` rows and only
    those are merged, so no full sort runs. ``limit=None`` is a full sort.
    """
    keys = list(order) + list(tie_breakers or [])
    out = df.orderBy(*keys)
    return out if limit is None else out.limit(int(limit))
