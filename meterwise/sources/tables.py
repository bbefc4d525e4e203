"""Scans of the fact tables.

A fact table is read by catalog name (``spark.table``) or by path
(``spark.read.parquet``) and bound to the fixed schema. Reading is lazy and
column-pruned; filters applied later by a report reach the scan through
Catalyst.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from meterwise import schemas
from meterwise.operators.windows import with_grain_checked


# Schemas of the test tables the adapters read. Declaring them skips the
# footer-reading job Spark otherwise runs on every ``read.parquet``.
TEST_TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


@dataclass
class SourceTables:
    """Parquet tables in one folder, ``<folder>/<name>.parquet``.

    Tables with a known schema are read with it (no inference job); others
    fall back to Parquet schema inference.
    """

    spark: SparkSession
    folder: str
    schemas: dict = field(default_factory=lambda: dict(TEST_TABLE_SCHEMAS))
    _cache: dict = field(default_factory=dict, repr=False)

    def __call__(self, name: str) -> DataFrame:
        if name not in self._cache:
            path = f"{self.folder.rstrip('/')}/{name}.parquet"
            reader = self.spark.read
            if name in self.schemas:
                reader = reader.schema(self.schemas[name])
            self._cache[name] = reader.parquet(path)
        return self._cache[name]

    def holds(self, name: str) -> bool:
        """Whether ``name`` was read or given before."""
        return name in self._cache

    def copy(self) -> "SourceTables":
        """The same tables, to which others can be added."""
        return type(self)(self.spark, self.folder, self.schemas, dict(self._cache))

    def with_table(self, name: str, df: DataFrame) -> "SourceTables":
        """Use ``df`` for ``name`` (e.g. a table derived from the original)."""
        self._cache[name] = df
        return self


def qualified_name(*parts: str) -> str:
    """``catalog``, ``schema``, ``table`` (or fewer) as one quoted name."""
    if not parts or not all(p and p.strip() for p in parts):
        raise ValueError(f"empty part in table name {parts!r}")
    return ".".join("`" + p.strip().replace("`", "``") + "`" for p in parts)


def load_like(spark: SparkSession, source: str, model: str) -> DataFrame:
    """The Parquet folder ``source`` with the schema of ``model``, so that a
    folder without any file is an empty table."""
    return spark.read.schema(_load(spark, model).schema).parquet(source)


def _load(spark: SparkSession, source: str) -> DataFrame:
    if not source.startswith("`") and ("/" in source or source.endswith(".parquet")):
        return spark.read.parquet(source)
    return spark.table(source)


def read_account_monthly(spark: SparkSession, source: str,
                         mapping: Mapping[str, str] | None = None, check_grain: bool = False,
                         like: str | None = None) -> DataFrame:
    """Fact A by table name or Parquet path.

    ``mapping`` maps neutral names to source columns; pass
    ``schemas.ACCOUNT_MONTHLY_SOURCE_COLUMNS`` for the production layout.
    Two rows of one account and month fail every report with a previous-month
    window; ``check_grain`` fails any use of the table that reads
    ``account_id``, at the price of a shuffle. ``like`` names a table whose
    schema this path has.
    """
    raw = _load(spark, source) if like is None else load_like(spark, source, like)
    fact = schemas.bind(raw, schemas.ACCOUNT_MONTHLY, mapping,
                        keep_account_type=True)
    return with_grain_checked(fact) if check_grain else fact


def read_usage_lines(spark: SparkSession, source: str, mapping: Mapping[str, str] | None = None,
                     like: str | None = None) -> DataFrame:
    """Fact B by table name or Parquet path (see ``read_account_monthly``).

    A ``usage_month`` partition column, when present, is kept so that date
    filters can prune month folders.
    """
    raw = _load(spark, source) if like is None else load_like(spark, source, like)
    extra = {schemas.USAGE_MONTH: T.DateType()} if schemas.USAGE_MONTH in raw.columns else None
    return schemas.bind(raw, schemas.USAGE_LINES, mapping, extra=extra)
