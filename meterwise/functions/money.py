"""Money and percentage columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_money(c, scale: int = 2) -> Column:
    """Round half-up on the exact (decimal) value, then emit a double."""
    return F.round(_col(c), scale).cast("double")


def pct_change(cur, prev) -> Column:
    """``(cur - prev) / prev * 100`` when ``prev > 0``, else NULL.

    The difference is exact (decimal); the division runs in double, since a
    wide decimal division keeps only six fractional digits.
    """
    c, p = _col(cur), _col(prev)
    return F.when(p > 0, (c - p).cast("double") / p.cast("double") * F.lit(100.0))
