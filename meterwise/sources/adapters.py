"""Adapters: the TPC-H-style test tables bound as fact A and fact B.

Fact A (account x month) is built as

    lineitem JOIN orders --aggregate by (customer, month)--> JOIN customer
    --> nation --> region

The line-to-order join pairs two fact tables that both grow with the data,
so it is always a shuffled sort-merge join (``merge`` hint): broadcasting
``orders`` is never safe at scale, and it would also pin all per-line decimal
work to the scan tasks. The aggregation by (customer, month) is partial +
final (map-side combine) and runs *before* the customer join, so a customer
holding a large share of all orders costs one partial row per task and at
most one row per month in that join. Customer, nation and region are joined
by Spark's own size check (broadcast under ``autoBroadcastJoinThreshold``,
sort-merge above it).

Fact B (usage line) is lineitem joined to orders the same way, with supplier
and part looked up only when their columns are asked for. When the caller
asks for one account, the orders side is filtered to it first and the join
strategy is left to Spark's size checks (AQE turns it into a broadcast only
when the measured side is small).

``write_facts`` needs both facts whole, so the lines meet their orders once for
both (``with_order_lines``): that table is staged, and the adapters read it in
place of the joins where a ``SourceTables`` holds it.

``months`` / ``dates`` add exact predicates on the raw order/ship timestamps
so that a report's date range reaches the Parquet scan (``PushedFilters``);
``account_id`` does the same for the string account id of fact B, whose
source is an integer key. The report still applies its own filter on the
derived column.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise import schemas
from meterwise.functions.dates import first_month_after, first_month_on_or_after, month_start
from meterwise.sources.staging import staged
from meterwise.sources.tables import SourceTables

# Fixed values of the adapter: the segment whose submitted forecast is absent,
# and the return flag whose lines count as zero actual consumption.
NO_SUBMITTED_FORECAST_SEGMENT = "MACHINERY"
RETURNED_FLAG = "R"

#: Name of the joined lines in a ``SourceTables``.
ORDER_LINES = "order_lines"
#: Marks one of the rows that repeated supplier or part rows make of a line.
FIRST = "_first"


def line_price() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)")


def line_net() -> Column:
    """price * (1 - discount), both cast to decimal *before* multiplying."""
    return line_price() * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))


def line_gross() -> Column:
    """price * (1 + tax)."""
    return line_price() * (F.lit(1) + F.col("l_tax").cast("decimal(4,2)"))


def _raw_range(col: str, first: date | None, stop: date | None) -> Column | None:
    """``first <= col < stop`` on a raw date/timestamp column (either side open)."""
    cond = None
    if first is not None:
        cond = F.col(col) >= F.lit(first)
    if stop is not None:
        c = F.col(col) < F.lit(stop)
        cond = c if cond is None else cond & c
    return cond


def _numbered(df: DataFrame, key: str, name: str, n: str) -> DataFrame:
    """A dimension's key and name, the rows of one key numbered from 1."""
    return df.select(key, name, F.row_number().over(Window.partitionBy(key).orderBy(name)).alias(n))


def order_lines(tables: SourceTables) -> DataFrame:
    """Lines with their orders' customer and date and the names of supplier and
    part: what both facts are made of. Prices stay as read but for their type,
    which they get first, so that the shuffles carry small numbers. The lines
    meet their orders after the parts: the lines of one order then lie together,
    and fact A sums them before its own shuffle.

    A repeated supplier or part row repeats a line for fact B, but not for fact A,
    which reads the rows marked ``FIRST``."""
    orders = tables("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"))
    lines = tables("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,2)").alias("l_quantity"),
        line_price().alias("l_extendedprice"),
        *[F.col(c).cast("decimal(4,2)").alias(c) for c in ("l_discount", "l_tax")],
        (F.col("l_returnflag") == RETURNED_FLAG).alias("returned"), F.to_date("l_shipdate").alias("l_shipdate"))
    supplier = _numbered(tables("supplier"), "s_suppkey", "s_name", "_s")
    part = _numbered(tables("part"), "p_partkey", "p_brand", "_p")
    first = lambda n: F.coalesce(n, F.lit(1)) == 1
    named = (lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
             .withColumn(FIRST, first("_p")).drop("l_partkey", "p_partkey", "_p"))
    return (named.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
            .select("o_custkey", "o_orderdate", "l_suppkey", "s_name", "p_brand", "l_shipdate", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "returned", (first("_s") & F.col(FIRST)).alias(FIRST)))


def with_order_lines(tables: SourceTables) -> SourceTables:
    """``tables`` with the joined lines, staged (as they are, if there already)."""
    if tables.holds(ORDER_LINES):
        return tables
    return tables.copy().with_table(ORDER_LINES, staged(order_lines(tables), "order-lines"))


def account_monthly(tables: SourceTables, months: tuple[date, date] | None = None,
                    name_pattern: str = "%") -> DataFrame:
    """Fact A from the test tables.

    ``months=(start, end)`` keeps only rows whose month ``m`` satisfies
    ``start <= m <= end``; the same predicate a report applies to ``month``,
    turned into an exact range on the raw order date. ``name_pattern`` other
    than ``%`` keeps only the orders of customers whose name matches before
    they meet the lines, so the lines that are shuffled on can be pruned by
    the orders that are left.
    """
    joined = tables.holds(ORDER_LINES)
    orders = tables(ORDER_LINES).where(FIRST) if joined else tables("orders").select(
        "o_orderkey", "o_custkey", "o_orderdate")
    if months is not None:
        start, end = months
        orders = orders.filter(_raw_range(
            "o_orderdate", first_month_on_or_after(start), first_month_after(end)))
    customer = tables("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    if name_pattern != "%":
        customer = customer.filter(F.col("c_name").ilike(name_pattern))
        orders = orders.join(customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    if joined:
        lines = orders
    else:
        lines = tables("lineitem").select(
            "l_orderkey", "l_extendedprice", "l_discount", "l_tax",
            (F.col("l_returnflag") == RETURNED_FLAG).alias("returned")
        ).join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    monthly = (
        lines.groupBy(F.col("o_custkey"), month_start("o_orderdate").alias("month"))
        .agg(
            F.sum(F.when(F.col("returned"), F.lit(0)).otherwise(line_net()))
            .alias("amount"),
            F.sum(line_net()).alias("baseline"),
            F.sum(line_gross()).alias("model_forecast"),
            F.sum(line_price()).alias("submitted_sum"),
        )
    )
    nation = tables("nation").select("n_nationkey", "n_name", "n_regionkey")
    region = tables("region").select("r_regionkey", "r_name")
    joined = (
        monthly.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    return joined.select(
        F.col("o_custkey").cast("bigint").alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.col("month"),
        F.col("amount").cast(schemas.MONEY_SUM).alias("amount"),
        F.col("baseline").cast(schemas.MONEY_SUM).alias("baseline"),
        F.col("model_forecast").cast(schemas.MONEY_SUM).alias("model_forecast"),
        F.when(F.col("c_mktsegment") == NO_SUBMITTED_FORECAST_SEGMENT, F.lit(None))
        .otherwise(F.col("submitted_sum")).cast(schemas.MONEY_SUM).alias("submitted_forecast"),
        F.col("r_name").alias("unit"),
        F.col("n_name").alias("sub_unit"),
    )


def dollars_by_part(tables: SourceTables, dates: tuple[date, date]) -> DataFrame:
    """Fact B's ``sku_name`` and ``dollars``, summed per part before the part
    lookup: the join carries one row per part instead of one per line."""
    lines = lines_between(tables("lineitem"), dates)
    orders = tables("orders").select("o_orderkey").hint("merge")
    per_part = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                .groupBy("l_partkey").agg(F.sum(line_net().cast(schemas.MONEY_LINE)).alias("dollars")))
    part = tables("part").select("p_partkey", "p_brand")
    return (per_part.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
            .select(F.col("p_brand").alias("sku_name"), "dollars"))


def _custkey_for(account_id: str) -> Column:
    """``o_custkey`` predicate equivalent to ``cast(o_custkey as string) = account_id``.

    Only a canonical integer string can equal a cast integer, so the numeric
    form (pushable to Parquet) is exact; any other string matches nothing.
    """
    s = str(account_id)
    if re.fullmatch(r"-?(0|[1-9][0-9]{0,18})", s) and -2**63 <= int(s) < 2**63:
        return F.col("o_custkey") == F.lit(int(s))
    return F.lit(False)


def lines_between(lines: DataFrame, dates: tuple[date, date] | None) -> DataFrame:
    """Lines shipped on the days ``start..end``."""
    if dates is None:
        return lines
    start, end = dates
    return lines.filter(_raw_range("l_shipdate", start, date.fromordinal(end.toordinal() + 1)))


def _usage_columns(want: list[str]) -> list[tuple[str, Column]]:
    """Fact B's columns from the joined lines."""
    exprs = {
        "account_id": F.col("o_custkey").cast("string"),
        "workspace_id": F.col("l_suppkey").cast("string"),
        "workspace_name": F.col("s_name") if "workspace_name" in want else None,
        "sku_name": F.col("p_brand") if "sku_name" in want else None,
        "usage_date": F.to_date(F.col("l_shipdate")),
        "quantity": F.col("l_quantity").cast("decimal(18,2)").cast(schemas.MONEY_LINE),
        "dollars": line_net().cast(schemas.MONEY_LINE),
        "dollars_at_list": line_price().cast(schemas.MONEY_LINE),
    }
    return [(c, exprs[c]) for c in want]


def usage_lines(tables: SourceTables, columns: list[str] | None = None,
                dates: tuple[date, date] | None = None, account_id: str | None = None) -> DataFrame:
    """Fact B from the test tables, one row per line item.

    ``columns`` restricts the output (and skips the supplier / part lookups
    when their columns are not needed). ``dates=(start, end)`` keeps lines
    with ``start <= usage_date <= end`` via a range on the raw ship date;
    ``account_id`` keeps that account's lines via the integer order key.
    """
    want = list(columns or schemas.USAGE_LINES.fieldNames())
    joined = tables.holds(ORDER_LINES)
    li = tables(ORDER_LINES if joined else "lineitem")
    li = lines_between(li, dates)
    if joined:
        lines = li if account_id is None else li.filter(_custkey_for(account_id))
        return lines.select(*[c.alias(n) for n, c in _usage_columns(want)])
    orders = tables("orders").select("o_orderkey", "o_custkey")
    if account_id is None:
        # All accounts: orders is unbounded, always a sort-merge join.
        orders = orders.hint("merge")
    else:
        # One account: its orders may be few or (a hot account) very many, so
        # the strategy is left to Spark's size checks -- static statistics,
        # then AQE's runtime conversion from measured shuffle sizes.
        orders = orders.filter(_custkey_for(account_id))
    lines = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "workspace_name" in want:
        supplier = tables("supplier").select("s_suppkey", "s_name")
        lines = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    if "sku_name" in want:
        part = tables("part").select("p_partkey", "p_brand")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return lines.select(*[c.alias(n) for n, c in _usage_columns(want)])
