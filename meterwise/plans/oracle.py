"""DuckDB oracle SQL, one statement per registered query.

Written from the report rules (SURVEY 2.12), in a form of its own: the previous
row is found by joining numbered rows, forecast months are enumerated as
year x month of the year, and each year's growth and factor are listed in a
table. Money is exact decimal up to the final ``ROUND(.., 2)``, then DOUBLE.
"""

from __future__ import annotations

FACT_A = """
fact_a AS (
  SELECT c.c_custkey AS account_id,
         c.c_name AS account_name,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) AS month,
         SUM(CASE WHEN li.l_returnflag = 'R' THEN 0
                  ELSE CAST(li.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(li.l_discount AS DECIMAL(4,2))) END) AS amount,
         SUM(CAST(li.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(li.l_discount AS DECIMAL(4,2)))) AS baseline,
         SUM(CAST(li.l_extendedprice AS DECIMAL(18,2)) * (1 + CAST(li.l_tax AS DECIMAL(4,2)))) AS model_forecast,
         CASE WHEN c.c_mktsegment = 'MACHINERY' THEN NULL
              ELSE SUM(CAST(li.l_extendedprice AS DECIMAL(18,2))) END AS submitted_forecast,
         r.r_name AS unit,
         n.n_name AS sub_unit
  FROM lineitem li
  JOIN orders o ON li.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY c.c_custkey, c.c_name, CAST(date_trunc('month', o.o_orderdate) AS DATE),
           c.c_mktsegment, r.r_name, n.n_name
)"""

FACT_B = """
fact_b AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS account_id,
         CAST(li.l_suppkey AS VARCHAR) AS workspace_id,
         s.s_name AS workspace_name,
         p.p_brand AS sku_name,
         CAST(li.l_shipdate AS DATE) AS usage_date,
         CAST(CAST(li.l_quantity AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS quantity,
         CAST(CAST(li.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(li.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS dollars,
         CAST(CAST(li.l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS dollars_at_list
  FROM lineitem li
  JOIN orders o ON li.l_orderkey = o.o_orderkey
  LEFT JOIN supplier s ON li.l_suppkey = s.s_suppkey
  LEFT JOIN part p ON li.l_partkey = p.p_partkey
)"""


def _cents(column: str, name: str | None = None) -> str:
    return f"CAST(ROUND({column}, 2) AS DOUBLE) AS {name or column}"


FACT_A_MONEY = ", ".join(_cents(c) for c in ("baseline", "model_forecast", "submitted_forecast"))
HISTORY_ORDER = "account_name NULLS FIRST, month DESC NULLS LAST, account_id NULLS FIRST"


HISTORY_STRICT = f"""WITH {FACT_A},
shown AS (SELECT * FROM fact_a WHERE account_name IS NOT NULL AND month BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'),
paired AS (
  SELECT cur.*, before.amount AS prev_amount,
         IF(before.amount > 0, 100 * (CAST(cur.amount - before.amount AS DOUBLE) / CAST(before.amount AS DOUBLE)),
            NULL) AS pct
  FROM shown cur LEFT JOIN shown before
  ON before.account_id = cur.account_id AND cur.month = before.month + INTERVAL 1 MONTH
)
SELECT account_name, month, {_cents('amount')}, {_cents('prev_amount')}, ROUND(pct, 2) AS mom_growth_pct,
       {FACT_A_MONEY}, unit, sub_unit
FROM paired WHERE amount > 0"""


def _history(pattern: str, min_growth: float | None, limit: int | None) -> str:
    """P1 over 1996-2000. R3: the predecessor is the account's previous row in
    range, whatever its month; R4: it may be a row that is not shown."""
    wanted = "" if min_growth is None else f"AND (pct IS NULL OR pct >= {float(min_growth)})"
    top = "" if limit is None else f"ORDER BY {HISTORY_ORDER} LIMIT {limit}"
    return f"""WITH {FACT_A},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY month) AS k
  FROM fact_a WHERE account_name ILIKE '{pattern}' AND month BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
),
paired AS (
  SELECT cur.*, before.amount AS prev_amount,
         IF(before.amount > 0, 100 * (CAST(cur.amount - before.amount AS DOUBLE) / CAST(before.amount AS DOUBLE)),
            NULL) AS pct
  FROM numbered cur LEFT JOIN numbered before ON before.account_id = cur.account_id AND before.k + 1 = cur.k
)
SELECT account_name, month, {_cents('amount')}, {_cents('prev_amount')}, ROUND(pct, 2) AS mom_growth_pct,
       {FACT_A_MONEY}, unit, sub_unit
FROM paired WHERE amount > 0 {wanted} {top}"""


def _forecast_period(limit: int | None) -> str:
    top = "" if limit is None else f"ORDER BY account_name NULLS FIRST, month NULLS FIRST, account_id NULLS FIRST LIMIT {limit}"
    return f"""WITH {FACT_A}
SELECT account_name, month, {_cents('amount')}, {FACT_A_MONEY}, unit, sub_unit
FROM fact_a WHERE account_name IS NOT NULL AND month BETWEEN DATE '2000-01-01' AND DATE '2001-06-01' {top}"""


MONTH = "CAST(date_trunc('month', usage_date) AS DATE)"
HISTORY_RANGE = "usage_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"
# The month before the end month, and the end month up to the end date.
TRAILING_RANGE = "usage_date BETWEEN DATE '2000-11-01' AND DATE '2000-12-31'"


def _usage_report(account: str | None, limit: int | None) -> str:
    only = "TRUE" if account is None else f"account_id = '{account}'"
    top = "" if limit is None else (
        "ORDER BY month DESC NULLS LAST, dollars DESC NULLS LAST, account_id NULLS FIRST, workspace_id NULLS FIRST, "
        f"workspace_name NULLS FIRST, sku_name NULLS FIRST, quantity NULLS FIRST, dollars_at_list NULLS FIRST LIMIT {limit}")
    return f"""WITH {FACT_B}
SELECT account_id, workspace_id, workspace_name, sku_name, {MONTH} AS month, CAST(quantity AS DOUBLE) AS quantity,
       CAST(dollars AS DOUBLE) AS dollars, CAST(dollars_at_list AS DOUBLE) AS dollars_at_list
FROM fact_b WHERE {only} AND {HISTORY_RANGE} {top}"""


def _usage_by(key: str, name: str) -> str:
    return f"""WITH {FACT_B}
SELECT {key} AS {name}, {_cents('SUM(dollars)', 'dollars')} FROM fact_b WHERE {HISTORY_RANGE} GROUP BY ALL"""


MONTH_SPINE = f"""WITH {FACT_B},
span AS (SELECT account_id, MIN({MONTH}) AS a, MAX({MONTH}) AS b FROM fact_b GROUP BY account_id)
SELECT account_id, CAST(unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS month FROM span"""

# Year buckets count from 1998-01 (R14); months before 1998-01-15 are history.
YEAR_BUCKET = f"""WITH {FACT_B},
monthly AS (SELECT {MONTH} AS month, SUM(dollars) AS d FROM fact_b GROUP BY ALL),
placed AS (
  SELECT d, IF(month < DATE '1998-01-15', NULL, 1 + (12 * (year(month) - 1998) + month(month) - 1) // 12) AS y FROM monthly
)
SELECT CAST(y AS INTEGER) AS yr_num, COALESCE('Yr' || CAST(y AS VARCHAR), 'Historical') AS year_bucket,
       COUNT(*) AS months, {_cents('SUM(d)', 'dollars')}
FROM placed GROUP BY ALL"""


def _trailing(account: str | None, fallback: int) -> str:
    """Baseline table (account_id, total): one row for ``account``, whether it
    exists or not, or one per account (R20)."""
    who = "SELECT DISTINCT account_id FROM fact_b" if account is None else f"SELECT '{account}' AS account_id"
    return f"""base AS (
  SELECT who.account_id, COALESCE(CAST(SUM(dollars) AS DECIMAL(28,4)), {fallback}) AS total
  FROM ({who}) who LEFT JOIN (SELECT * FROM fact_b WHERE {TRAILING_RANGE}) u ON u.account_id = who.account_id
  GROUP BY who.account_id
)"""


def _latest(account: str | None) -> str:
    """Baseline table from each account's latest month with usage; 0 and no
    usage count as 1."""
    who = "SELECT DISTINCT account_id FROM fact_b" if account is None else f"SELECT '{account}' AS account_id"
    return f"""monthly AS (
  SELECT account_id, {MONTH} AS month, CAST(SUM(dollars) AS DECIMAL(28,4)) AS t FROM fact_b
  WHERE {HISTORY_RANGE} GROUP BY ALL
),
base AS (
  SELECT who.account_id, COALESCE(NULLIF(t, 0), 1) AS total
  FROM ({who}) who LEFT JOIN (SELECT * FROM monthly QUALIFY month = MAX(month) OVER (PARTITION BY account_id)) m
  ON m.account_id = who.account_id
)"""


def _baseline(base: str, every: bool) -> str:
    key = "account_id, " if every else ""
    return f"WITH {FACT_B},\n{base}\nSELECT {key}CAST(total AS DOUBLE) AS baseline_dollars FROM base"


# R12/R13 with rates 5, 10 and 20 %: (year, rate shown, factor on the baseline).
# Flat: the product of the rates up to the year, the same after the third.
FLAT_YEARS = [(1, 5, "1.05"), (2, 10, "1.05 * 1.10"), (3, 20, "1.05 * 1.10 * 1.20")]
# Compound: a year's own rate on all earlier rates; from the fourth year on its
# own rate is the third's, and earlier years count 5 % each.
COMPOUND_YEARS = FLAT_YEARS + [(4, 20, "1.05 * 1.10 * 1.20 * 1.20"), (5, 20, "1.05 * 1.10 * 1.20 * 1.05 * 1.20"),
                               (6, 20, "1.05 * 1.10 * 1.20 * 1.05 * 1.05 * 1.20")]


def _projected(base: str, years: list[tuple[int, int, str]], start: str, end: str) -> str:
    """CTEs up to ``projected`` (account_id, month, y, rate, dollars): the
    baseline times the year's factor for the twelve months of each year, from
    ``start`` (raw) to ``end``."""
    table = ", ".join(f"({y}, {rate}, CAST({factor} AS DECIMAL(9,7)))" for y, rate, factor in years)
    return f"""WITH {FACT_B},
{base},
years(y, rate, factor) AS (VALUES {table}),
projected AS (
  SELECT account_id, CAST(date_trunc('month', DATE '{start}') + to_months(12 * (y - 1) + CAST(k AS INTEGER)) AS DATE) AS month,
         y, rate, ROUND(total * factor, 2) AS dollars
  FROM base, years, range(12) t(k)
)"""


def _scenario(base: str, years: list[tuple[int, int, str]], start: str, end: str, every: bool) -> str:
    key = "account_id, " if every else ""
    return f"""{_projected(base, years, start, end)}
SELECT {key}month, 'Yr' || CAST(y AS VARCHAR) AS year_bucket, CAST(rate AS DOUBLE) AS organic_growth_pct,
       CAST(dollars AS DOUBLE) AS projected_usage_dollars
FROM projected WHERE month BETWEEN DATE '{start}' AND DATE '{end}'"""


def _scenario_totals(base: str, years: list[tuple[int, int, str]], start: str, end: str) -> str:
    return f"""{_projected(base, years, start, end)}
SELECT month, CAST(SUM(dollars) AS DOUBLE) AS projected_usage_dollars
FROM projected WHERE month BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY month"""


# Rates of an account from its own totals of 1997 to 2000, oldest first: hundredths
# of a percent, half up, from 10,000ths of a dollar; 5 % where there is nothing to
# grow from, and no rate outside -100..500 %. A factor is rounded to eight digits a year.
def _rate(year: int) -> str:
    return f"""CASE WHEN y{year - 1} <= 0 THEN 500 WHEN y{year} >= 6 * y{year - 1} THEN 50000
       ELSE (20000 * greatest(y{year}, 0) + y{year - 1}) // (2 * y{year - 1}) - 10000 END"""


def _year_total(year: int) -> str:
    return f"CAST(10000 * COALESCE(SUM(dollars) FILTER (year(usage_date) = {year}), 0) AS HUGEINT) AS y{year}"


_CARRIED = "CAST(0.05 AS DECIMAL(7,2))"
_STEP = "CAST(list_reduce(list_prepend(CAST(1 AS DECIMAL(18,8)), {}), lambda f, g: CAST(f * g AS DECIMAL(18,8))) AS DECIMAL(18,8))"


def _own_growth(base: str, end_year: int) -> str:
    """Compound rule with each account's own three rates, for six years."""
    rates = ", ".join(_rate(y) for y in range(end_year - 2, end_year + 1))
    totals = ", ".join(_year_total(y) for y in range(end_year - 3, end_year + 1))
    return f"""WITH {FACT_B},
{base},
totals AS (SELECT account_id, {totals} FROM fact_b
           WHERE usage_date BETWEEN DATE '{end_year - 3}-01-01' AND DATE '{end_year}-12-31' GROUP BY account_id),
rated AS (SELECT account_id, [{rates}] AS bp FROM totals),
given AS (SELECT base.account_id, total, list_transform(COALESCE(bp, [500, 1000, 2000]),
                 lambda r: CAST(CAST(r AS DECIMAL(12,0)) / 100 AS DECIMAL(7,2))) AS g
          FROM base LEFT JOIN rated ON rated.account_id = base.account_id),
factors AS (SELECT account_id, total, y, g[least(y, 3)] AS rate, {_STEP.format(
        "list_transform(list_concat((g || [5::DECIMAL(7,2), 5::DECIMAL(7,2)])[1:y - 1], [g[least(y, 3)]]), "
        "lambda r: CAST(1 + r / 100 AS DECIMAL(18,8)))")} AS factor
            FROM given, range(1, 7) t(y))
SELECT account_id, CAST(DATE '{end_year + 1}-01-01' + to_months(CAST(12 * (y - 1) + k AS INTEGER)) AS DATE) AS month,
       'Yr' || CAST(y AS VARCHAR) AS year_bucket, CAST(rate AS DOUBLE) AS organic_growth_pct,
       CAST(ROUND(CAST(total AS DECIMAL(19,4)) * factor, 2) AS DOUBLE) AS projected_usage_dollars
FROM factors, range(12) u(k)"""


FLAT_MONTHS = ("2001-01-01", "2003-12-01")
COMPOUND_MONTHS = ("2001-01-01", "2006-12-01")
MID_MONTH = ("2001-01-15", "2006-12-01")

ORACLE_SQL: dict[str, str] = {
    "history_mom": _history("%", None, None),
    "history_mom_min_growth": _history("%", 5, None),
    "history_name_pattern": _history("%customer#0000000%", 5, None),
    "history_top": _history("%", None, 500),
    "history_strict_calendar": HISTORY_STRICT,
    "forecast_period": _forecast_period(None),
    "forecast_period_top": _forecast_period(100),
    "usage_report": _usage_report("42", None),
    "usage_report_top": _usage_report(None, 200),
    "usage_by_month": _usage_by(MONTH, "month"),
    "usage_by_sku": _usage_by("sku_name", "sku_name"),
    "month_spine": MONTH_SPINE,
    "year_bucket": YEAR_BUCKET,
    "baseline_trailing": _baseline(_trailing("9", 0), False),
    "baseline_trailing_none": _baseline(_trailing("-1", 0), False),
    "baseline_trailing_all": _baseline(_trailing(None, 0), True),
    "baseline_latest_month": _baseline(_latest(None), True),
    "scenario_flat": _scenario(_trailing("9", 1), FLAT_YEARS, *FLAT_MONTHS, every=False),
    "scenario_flat_none": _scenario(_trailing("-1", 1), FLAT_YEARS, *FLAT_MONTHS, every=False),
    "scenario_flat_all": _scenario(_trailing(None, 1), FLAT_YEARS, *FLAT_MONTHS, every=True),
    "scenario_compound": _scenario(_latest("42"), COMPOUND_YEARS, *COMPOUND_MONTHS, every=False),
    "scenario_compound_all": _scenario(_latest(None), COMPOUND_YEARS, *MID_MONTH, every=True),
    "scenario_compound_own_growth": _own_growth(_latest(None), 2000),
    "projected_by_month": _scenario_totals(_trailing(None, 1), FLAT_YEARS, *FLAT_MONTHS),
    "projected_by_month_compound": _scenario_totals(_latest(None), COMPOUND_YEARS, *MID_MONTH),
}
ORACLE_SQL |= {"served_history_mom": ORACLE_SQL["history_mom"],
               "served_baseline_latest_month": ORACLE_SQL["baseline_latest_month"],
               "served_usage_by_month": ORACLE_SQL["usage_by_month"],
               "served_history_name_pattern": ORACLE_SQL["history_name_pattern"],
               "served_scenario_compound_own_growth": ORACLE_SQL["scenario_compound_own_growth"],
               "refreshed_history_mom": ORACLE_SQL["history_mom"],
               "refreshed_baseline_latest_month": ORACLE_SQL["baseline_latest_month"]}
