"""Small hand-written fact frames for the rule cases."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from meterwise import schemas


def account_monthly(spark, rows):
    """rows: (account_id, name, month, amount[, baseline, model, submitted])."""
    full = []
    for r in rows:
        acct, name, month, amount = r[:4]
        extra = list(r[4:]) + [None] * (3 - len(r[4:]))
        full.append((acct, name, month, _d(amount), *[_d(x) for x in extra], "U", "S"))
    return spark.createDataFrame(full, schemas.ACCOUNT_MONTHLY)


def usage_lines(spark, rows):
    """rows: (account_id, usage_date or timestamp, dollars[, sku])."""
    full = []
    for r in rows:
        acct, when, dollars = r[:3]
        sku = r[3] if len(r) > 3 else "SKU"
        full.append((acct, "w1", "ws", sku, when, Decimal(1), _d(dollars), _d(dollars)))
    schema = schemas.USAGE_LINES
    if any(isinstance(r[1], datetime) for r in rows):
        from pyspark.sql import types as T

        raw = T.StructType([
            f if f.name != "usage_date" else T.StructField("usage_date", T.TimestampNTZType(), False)
            for f in schema.fields
        ])
        return schemas.bind(spark.createDataFrame(full, raw), schema)
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(full, schema)


def _d(x):
    return None if x is None else Decimal(str(x))


def m(year, month, day=1):
    return date(year, month, day)


__all__ = ["account_monthly", "usage_lines", "m", "F"]
