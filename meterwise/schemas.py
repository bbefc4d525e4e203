"""Fixed schemas of the two fact tables and binding of source tables to them.

Fact A is one row per account and month; fact B is one row per usage line.
Any source table is bound to the neutral column names with a column mapping,
and date-like columns are normalised to ``date`` (a timestamp compared with
``<= date`` would lose the last day).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Monthly sums are kept wide: a single hot account may hold a large share of
# all usage, and decimal(18,4) would overflow (an ANSI-mode error) long before
# decimal(38,4) does.
MONEY_SUM = T.DecimalType(38, 4)
MONEY_LINE = T.DecimalType(18, 4)

ACCOUNT_MONTHLY = T.StructType([
    T.StructField("account_id", T.LongType(), False),
    T.StructField("account_name", T.StringType(), True),
    T.StructField("month", T.DateType(), False),
    T.StructField("amount", MONEY_SUM, True),
    T.StructField("baseline", MONEY_SUM, True),
    T.StructField("model_forecast", MONEY_SUM, True),
    T.StructField("submitted_forecast", MONEY_SUM, True),
    T.StructField("unit", T.StringType(), True),
    T.StructField("sub_unit", T.StringType(), True),
])

USAGE_LINES = T.StructType([
    T.StructField("account_id", T.StringType(), False),
    T.StructField("workspace_id", T.StringType(), True),
    T.StructField("workspace_name", T.StringType(), True),
    T.StructField("sku_name", T.StringType(), True),
    T.StructField("usage_date", T.DateType(), False),
    T.StructField("quantity", MONEY_LINE, True),
    T.StructField("dollars", MONEY_LINE, True),
    T.StructField("dollars_at_list", MONEY_LINE, True),
])

# Optional month partition column of a written usage table (first day of the
# month of ``usage_date``); date filters add the implied month predicate.
USAGE_MONTH = "usage_month"
MONTH_PARTITION_OF = {"usage_date": USAGE_MONTH}

# Column names of the production source tables, mapped to the
# neutral names used here (neutral name -> source column).
ACCOUNT_MONTHLY_SOURCE_COLUMNS = {
    "account_id": "account_id",
    "account_name": "account_name",
    "month": "usage_date",
    "amount": "dbu_dollars",
    "baseline": "organic_growth_baseline",
    "model_forecast": "forecast_consumption_ds",
    "submitted_forecast": "submitted_ae_forecast",
    "unit": "business_unit",
    "sub_unit": "BU1",
}
USAGE_LINES_SOURCE_COLUMNS = {
    "account_id": "sfdc_account_id",
    "workspace_id": "sfdc_workspace_id",
    "workspace_name": "sfdc_workspace_name",
    "sku_name": "sku_name",
    "usage_date": "date",
    "quantity": "usage_quantity",
    "dollars": "usage_dollars",
    "dollars_at_list": "usage_dollars_at_list",
}


def _typed(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        # Timestamps (with or without zone) become their calendar date.
        return F.to_date(c)
    return c.cast(dtype)


def bind(df: DataFrame, schema: T.StructType, mapping: Mapping[str, str] | None = None,
         keep_account_type: bool = False, extra: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """Select ``schema``'s columns from ``df`` through ``mapping``.

    ``mapping`` maps each neutral name to the source column (identity when a
    name is missing). Only the mapped columns are read, so Parquet scans stay
    pruned. ``keep_account_type`` leaves ``account_id`` in its source type
    (e.g. a string key in a table whose ids are strings). ``extra`` keeps
    further source columns (name -> type), e.g. a partition column.
    """
    mapping = dict(mapping or {})
    cols = []
    for f in schema.fields:
        src = F.col(mapping.get(f.name, f.name))
        if f.name == "account_id" and keep_account_type:
            cols.append(src.alias(f.name))
        else:
            cols.append(_typed(src, f.dataType).alias(f.name))
    for name, dtype in (extra or {}).items():
        cols.append(_typed(F.col(name), dtype).alias(name))
    return df.select(*cols)
