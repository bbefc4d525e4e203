"""Name patterns resolved on a name dimension (F1 on written facts).

A pattern such as ``%acme%`` has no prefix, so no statistics of the fact table
can skip a row group for it, and it is tested on every fact row. The dimension
written beside the facts holds each (account, name) once; the pattern is tested
there, and the fact scan gets the ids: as a literal list, which reaches Parquet's
row-group statistics (files are sorted by account), where at most ``PUSHED_IDS``
accounts match, otherwise as a semi-join, which Spark turns into a runtime Bloom
filter on the scan (or a broadcast, by its own size check). The pattern still
applies to the fact's own name, so an account that changed its name keeps only
the months under a matching one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.operators.filters import name_matches

#: Ids that a scan may get as a literal list; also the most that reach the driver.
PUSHED_IDS = 1000


def distinct_names(monthly: DataFrame, key: str = "account_id", name: str = "account_name") -> DataFrame:
    return monthly.select(key, name).distinct()


def accounts_named(df: DataFrame, names: DataFrame | None, pattern: str, key: str = "account_id",
                   name: str = "account_name") -> DataFrame:
    """Rows of ``df`` whose name matches ``pattern``, with the ids found in
    ``names`` (no dimension, or the pattern for all: the pattern alone)."""
    if names is None or pattern == "%":
        return name_matches(df, pattern, name)
    ids = name_matches(names, pattern, name).select(key).where(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in ids.limit(PUSHED_IDS + 1).collect()]
    if len(few) <= PUSHED_IDS:
        scoped = df.where(F.col(key).isin(sorted(few)) if few else F.lit(False))
    else:
        scoped = df.join(ids, key, "left_semi")
    return name_matches(scoped, pattern, name)
