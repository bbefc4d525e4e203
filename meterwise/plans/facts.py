"""Fact tables written once to the shared folder and read by every report.

The reports were designed against two prebuilt tables (account x month and
usage lines). ``write_facts`` builds both from the source tables and writes
them as Parquet under the cluster's shared ``spark.checkpoint.dir`` (or a
given folder); ``read_facts`` binds them back. Writing a table also cuts the
lineage: a lost executor re-reads files instead of recomputing the joins.

Layout, chosen for the reports' predicates:

* account x month, partitioned by ``month``, which every report filters
  (partition pruning). The staged rows are written without another shuffle by
  one task for ``MONTHLY_ROWS`` of them, so a month folder gets a file per task, each
  in account order. An account holds at most one row per month.
* usage lines, partitioned by ``usage_month`` (the month of ``usage_date``)
  and range-partitioned on (``usage_month``, ``account_id``, a hash of
  supplier, day and price): a date range prunes month folders (see
  ``operators.filters.in_date_range``), a month folder gets a few files with
  account ranges that do not overlap, so one account opens one of them, and
  the hash lets an account that holds a large share of a month split over
  several files. Only lines that are alike in these cannot be split. There is a
  range for every ``USAGE_ROWS`` lines, so a task sorts as many at any size.
* months, the total of each account and month with usage, partitioned by
  ``month`` and laid out like fact A: the latest-month baseline reads it from
  the newest month back.
* accounts, the accounts of the usage lines with their first and last month, so
  that reports on every account read the window and this narrow list instead
  of all lines.
* names, each (account, name) of fact A once, where name patterns are resolved.

The lines meet their orders once for both facts: these rows are staged unsorted
and narrow, fact A is summed from them, and the usage lines are dealt by range
(which samples its input first) from these files. Strings and amounts are made
after that shuffle, so it carries keys, prices and the two names.

Every call writes to a folder of its own, so two jobs never replace each
other's tables; a given ``root`` must not hold facts yet. ``refresh_facts``
rebuilds only some months: it writes their folders to a new version folder and
returns paths that put them in place of the older ones. Readers of the older
paths see no change, and a job that is run again overwrites just the month
folders it wrote (dynamic partition overwrite). ``compact_facts`` folds the
versions into one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.functions.dates import first_month_after, month_start
from meterwise.operators.latest_month import month_totals
from meterwise.operators.names import distinct_names
from meterwise.session import checkpoint_dir
from meterwise.sources.adapters import ORDER_LINES, account_monthly, lines_between, usage_lines, with_order_lines
from meterwise.sources.staging import staged_counted
from meterwise.sources.tables import SourceTables, read_account_monthly, read_usage_lines


#: Rows of fact A, of the narrow month totals and of the usage lines that one
#: task sorts and writes.
MONTHLY_ROWS, TOTALS_ROWS, USAGE_ROWS = 500_000, 2_000_000, 1_000_000


@dataclass(frozen=True)
class Refresh:
    """A version folder that replaces the months ``first..last`` (first days)
    of each fact; None where it leaves a fact as it was."""

    root: str
    monthly: tuple[date, date] | None
    usage: tuple[date, date] | None


@dataclass(frozen=True)
class FactPaths:
    account_monthly: str
    usage_lines: str
    accounts: str
    months: str
    names: str
    #: newest last
    refreshes: tuple[Refresh, ...] = ()


@dataclass(frozen=True)
class Facts:
    """The two facts, bound to the fixed schemas, and the narrow tables beside
    them: accounts, totals by account and month, names."""

    monthly: DataFrame
    usage: DataFrame
    accounts: DataFrame
    months: DataFrame
    names: DataFrame


def fact_paths(spark: SparkSession, root: str | None = None) -> FactPaths:
    """Paths under ``root``, or under a new folder of the shared folder."""
    base = (root or f"{checkpoint_dir(spark).rstrip('/')}/meterwise-facts-{uuid.uuid4().hex}").rstrip("/")
    return FactPaths(*[f"{base}/{name}" for name in ("account_monthly", "usage_lines", "accounts", "months", "names")])


def _write_months(df: DataFrame, path: str, month: str) -> str:
    """One folder per month; a job that is run again replaces its own folders."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
       .partitionBy(month).parquet(path))
    return path


def _write_account_months(df: DataFrame, label: str, path: str, task_rows: int) -> str:
    """Rows of one account and month: hashed by the aggregation that made them,
    so even shares of them go to each task."""
    rows, n = staged_counted(df, label)
    return _write_months(rows.coalesce(max(1, -(-n // task_rows))).sortWithinPartitions("month", "account_id"),
                         path, "month")


def write_account_monthly(df: DataFrame, path: str) -> str:
    return _write_account_months(df, "account-monthly", path, MONTHLY_ROWS)


def write_account_monthly_table(df: DataFrame, table: str, buckets: int, path: str) -> str:
    """Fact A as a catalog table bucketed by ``account_id`` (and partitioned
    by ``month``), so the history window reads it with no shuffle: a bucketed
    scan is already clustered by account. The files go to ``path``, which
    must be shared. ``buckets`` is the number of tasks of that window: choose
    it from the table's size.

    Safe only because the grain is one row per account and month: a hot
    account is at most one row per month in its bucket. (Usage lines are
    never bucketed by account: one account's bucket would be a single task
    reading all of its lines.)
    """
    (df.repartition(buckets, "account_id")
       .write.partitionBy("month").option("path", path)
       .bucketBy(buckets, "account_id").sortBy("account_id")
       .saveAsTable(table))
    return table


def _usage_tasks(n: int) -> list[int]:
    """Ranges of ``n`` usage lines, so that a task's sort stays as large whatever
    the table; up to ``USAGE_ROWS`` lines, as many as Spark chooses."""
    return [-(-n // USAGE_ROWS)] if n > USAGE_ROWS else []


def write_usage_lines(df: DataFrame, path: str) -> str:
    rest = [c for c in df.columns if c != "account_id"]
    rows, n = staged_counted(df, "usage-lines")
    return _write_ranged_lines(rows.repartitionByRange(
        *_usage_tasks(n), month_start("usage_date"), "account_id", F.xxhash64(*rest)), path)


def write_joined_usage(tables: SourceTables, path: str, dates: tuple[date, date] | None = None) -> str:
    """The usage lines (of ``dates``) from the staged lines that ``tables`` holds."""
    lines = lines_between(tables(ORDER_LINES), dates).select(
        "o_custkey", "l_suppkey", "s_name", "p_brand", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    ranged = lines.repartitionByRange(
        *_usage_tasks(lines.count()), month_start("l_shipdate"), F.col("o_custkey").cast("string"),
        F.xxhash64("l_suppkey", "l_shipdate", "l_extendedprice"))
    return _write_ranged_lines(usage_lines(tables.copy().with_table(ORDER_LINES, ranged)), path)


def _write_ranged_lines(lines: DataFrame, path: str) -> str:
    return _write_months(lines.withColumn("usage_month", month_start("usage_date"))
                         .sortWithinPartitions("usage_month", "account_id"), path, "usage_month")


def write_months(usage: DataFrame, path: str) -> str:
    """Totals by account and month."""
    return _write_account_months(month_totals(usage), "months", path, TOTALS_ROWS)


def write_accounts(months: DataFrame, path: str) -> str:
    months.groupBy("account_id").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month")
                                     ).write.parquet(path)
    return path


def write_names(monthly: DataFrame, path: str) -> str:
    distinct_names(monthly).write.parquet(path)
    return path


def write_facts(spark: SparkSession, tables: SourceTables, root: str | None = None,
                monthly_table: str | None = None, buckets: int | None = None) -> FactPaths:
    """Build fact A, fact B and the account list and write them.

    With ``monthly_table`` (and ``buckets``) fact A becomes a catalog table
    bucketed by account; ``read_facts`` reads either.
    """
    paths = fact_paths(spark, root)
    if monthly_table and not buckets:
        raise ValueError("a bucketed table needs the number of buckets")
    tables = with_order_lines(tables)
    if monthly_table:
        write_account_monthly_table(account_monthly(tables), monthly_table, buckets, paths.account_monthly)
        paths = FactPaths(monthly_table, paths.usage_lines, paths.accounts)
    else:
        write_account_monthly(account_monthly(tables), paths.account_monthly)
    write_joined_usage(tables, paths.usage_lines)
    write_names(read_account_monthly(spark, paths.account_monthly), paths.names)
    write_months(read_usage_lines(spark, paths.usage_lines), paths.months)
    write_accounts(_months(spark, paths.months), paths.accounts)
    return paths


def _months(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("account_id string, total decimal(28,4), lines long, month date").parquet(path)


def _month_of(d: date) -> date:
    return date(d.year, d.month, 1)


def _current(versions: list[tuple[DataFrame, tuple[date, date] | None]], month: str) -> DataFrame:
    """The base and its refreshes (with the months each replaces), newest
    last, as one table: every version without the months that a later one
    replaces. The conditions are on the partition column, so replaced folders
    are never listed for reading."""
    parts, hidden = [], []
    for df, replaced in reversed(versions):
        for first, last in hidden:
            df = df.where((F.col(month) < F.lit(first)) | (F.col(month) > F.lit(last)))
        parts.append(df)
        if replaced is not None:
            hidden.append(replaced)
    out = parts[-1]
    for df in reversed(parts[:-1]):
        out = out.unionByName(df)
    return out


def _monthly_now(spark: SparkSession, paths: FactPaths) -> DataFrame:
    return _current([(read_account_monthly(spark, paths.account_monthly), None)] + [
        (read_account_monthly(spark, fact_paths(spark, r.root).account_monthly, like=paths.account_monthly), r.monthly)
        for r in paths.refreshes if r.monthly], "month")


def _months_now(spark: SparkSession, paths: FactPaths) -> DataFrame:
    return _current([(_months(spark, paths.months), None)] + [
        (_months(spark, fact_paths(spark, r.root).months), r.usage) for r in paths.refreshes if r.usage], "month")


def read_facts(spark: SparkSession, paths: FactPaths) -> Facts:
    usage = _current([(read_usage_lines(spark, paths.usage_lines), None)] + [
        (read_usage_lines(spark, fact_paths(spark, r.root).usage_lines, like=paths.usage_lines), r.usage)
        for r in paths.refreshes if r.usage], "usage_month")
    return Facts(_monthly_now(spark, paths), usage, spark.read.parquet(paths.accounts), _months_now(spark, paths),
                 spark.read.parquet(paths.names))


def refresh_facts(spark: SparkSession, tables: SourceTables, paths: FactPaths,
                  monthly: tuple[date, date] | None = None, usage: tuple[date, date] | None = None,
                  root: str | None = None) -> FactPaths:
    """Rebuild the months ``monthly`` (first day of the first and last month)
    of fact A and ``usage`` of the usage lines from ``tables``, and nothing
    else: the sources are read for these months only, through the same pushed
    range as a report's. The totals of the refreshed usage months follow; the
    account list and the names, both narrow, are written anew from the totals
    and from the old names with the new months' (a name that no month holds any
    more does no harm: the pattern also applies to the facts). ``root`` is the
    version folder; give the same one to run a failed refresh again."""
    if monthly is None and usage is None:
        raise ValueError("name the months to refresh")
    whole = lambda span: None if span is None else (_month_of(span[0]), _month_of(span[1]))
    monthly, usage = whole(monthly), whole(usage)
    new = fact_paths(spark, root)
    base = new.accounts.rsplit("/", 1)[0]
    if monthly:
        write_account_monthly(account_monthly(tables, months=monthly), new.account_monthly)
    if usage:
        last = date.fromordinal(first_month_after(usage[1]).toordinal() - 1)
        if tables.holds(ORDER_LINES):
            write_joined_usage(tables, new.usage_lines, (usage[0], last))
        else:
            write_usage_lines(usage_lines(tables, dates=(usage[0], last)), new.usage_lines)
        write_months(read_usage_lines(spark, new.usage_lines, like=paths.usage_lines), new.months)
    out = FactPaths(paths.account_monthly, paths.usage_lines, paths.accounts, paths.months, paths.names,
                    (*paths.refreshes, Refresh(base, monthly, usage)))
    accounts, names = f"{base}/accounts-{uuid.uuid4().hex}", f"{base}/names-{uuid.uuid4().hex}"
    write_accounts(_months_now(spark, out), accounts)
    old = spark.read.parquet(paths.names)
    if monthly:
        old = old.unionByName(distinct_names(
            read_account_monthly(spark, new.account_monthly, like=paths.account_monthly)))
    write_names(old, names)
    return FactPaths(out.account_monthly, out.usage_lines, accounts, out.months, names, out.refreshes)


def compact_facts(spark: SparkSession, paths: FactPaths, root: str | None = None) -> FactPaths:
    """The current facts written as one version, without the source joins."""
    now, new = read_facts(spark, paths), fact_paths(spark, root)
    write_account_monthly(now.monthly, new.account_monthly)
    write_usage_lines(now.usage.drop("usage_month"), new.usage_lines)
    write_names(_monthly_now(spark, new), new.names)
    write_months(read_usage_lines(spark, new.usage_lines), new.months)
    write_accounts(_months(spark, new.months), new.accounts)
    return new
