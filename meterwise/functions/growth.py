"""Growth multipliers by forecast year.

The multipliers depend only on the rate parameters and the year number, so
they are computed as decimals from the parameters (28 significant digits, so
exact for a few years of rates with two decimals and rounded beyond that) and
enter the plan as a ``CASE`` on the year: no per-row loop, no binary floats.

Where each row brings rates of its own (an array column of percentages), the
factor is a fold over a slice of that array, in decimals with eight digits after
the point that are rounded half-up after every year.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_ONE = Decimal(1)
_HUNDRED = Decimal(100)


def _tidy(d: Decimal) -> Decimal:
    """Shortest equal form with a non-negative scale (valid Spark literal)."""
    if d == 0:
        return Decimal(0)
    n = d.normalize()
    return n if n.as_tuple().exponent <= 0 else n.quantize(_ONE)


def _factor(pct: Decimal) -> Decimal:
    return _ONE + Decimal(pct) / _HUNDRED


def year_growth_pct(rates_pct, yr: int) -> Decimal:
    """Rate of year ``yr``: Yr1, Yr2, then Yr3's rate for every later year."""
    return Decimal(rates_pct[min(yr, len(rates_pct)) - 1])


def flat_multipliers(rates_pct, years: int) -> list[Decimal]:
    """SQL rule: product of the yearly factors up to the year, flat after Yr3."""
    out, acc = [], _ONE
    for yr in range(1, years + 1):
        if yr <= len(rates_pct):
            acc = acc * _factor(rates_pct[yr - 1])
        out.append(_tidy(acc))
    return out


def compound_multipliers(rates_pct, years: int, carry_pct: Decimal) -> list[Decimal]:
    """Loop rule: keeps compounding after Yr3.

    Year ``n`` is ``prod(k < n) (1 + r_k) * (1 + g_n)`` where ``r_k`` is the
    year-``k`` rate for ``k <= 3`` and ``carry_pct`` after, and ``g_n`` is
    the year's rate (Yr3's for every later year).
    """
    out, carried = [], _ONE
    for yr in range(1, years + 1):
        if yr > 1:
            prev = yr - 1
            r = rates_pct[prev - 1] if prev <= len(rates_pct) else carry_pct
            carried = carried * _factor(r)
        m = carried * _factor(year_growth_pct(rates_pct, yr))
        out.append(_tidy(m))
    return out


#: Decimal type of a factor that is folded from rates in a column.
FACTOR = "decimal(18,8)"


def _fold(rates: Column) -> Column:
    """Product of ``1 + rate / 100`` over an array of decimal(7,2) rates."""
    return F.aggregate(rates, F.lit(1).cast(FACTOR),
                       lambda acc, r: (acc * (r.cast("decimal(7,2)") * F.lit(Decimal("0.01")) + F.lit(1))).cast(FACTOR))


def rate_of_year(rates: Column, yr: Column) -> Column:
    """The rate of year ``yr``: the last rate for every later year."""
    return F.get(rates, F.least(yr, F.size(rates)) - 1)


def flat_factor(rates: Column, yr: Column) -> Column:
    """SQL rule on a rate column: the product up to the year, flat after the
    last rate."""
    return _fold(F.slice(rates, F.lit(1), F.least(yr, F.size(rates))))


def compound_factor(rates: Column, yr: Column, carry_pct: Decimal) -> Column:
    """Loop rule on a rate column: earlier years at their own rates, those
    beyond the array at ``carry_pct``, times the year's own rate."""
    carried = F.array_repeat(F.lit(carry_pct).cast("decimal(7,2)"), F.greatest(yr - 1 - F.size(rates), F.lit(0)))
    earlier = F.slice(F.concat(rates.cast("array<decimal(7,2)>"), carried), F.lit(1), yr - 1)
    return _fold(F.concat(earlier, F.array(rate_of_year(rates, yr).cast("decimal(7,2)"))))


def by_year(yr: Column, values: list) -> Column:
    """``CASE yr WHEN 1 THEN values[0] ... ELSE values[-1]`` as a Column."""
    if not values:
        return F.lit(None)
    expr = None
    for i, v in enumerate(values[:-1], start=1):
        expr = (F.when(yr == i, F.lit(v)) if expr is None
                else expr.when(yr == i, F.lit(v)))
    last = F.lit(values[-1])
    return last if expr is None else expr.otherwise(last)
