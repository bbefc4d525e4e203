"""Column -> Column helpers (all JVM-side built-ins, no Python UDFs)."""

from meterwise.functions.dates import (
    month_start,
    month_sequence,
    months_since,
    month_ordinal,
    year_number,
    year_bucket,
    first_month_on_or_after,
    first_month_after,
    add_months,
)
from meterwise.functions.money import round_money, pct_change
from meterwise.functions.growth import (
    flat_multipliers,
    compound_multipliers,
    year_growth_pct,
    by_year,
    compound_factor,
    flat_factor,
    rate_of_year,
)

__all__ = [
    "month_start",
    "month_sequence",
    "months_since",
    "month_ordinal",
    "year_number",
    "year_bucket",
    "first_month_on_or_after",
    "first_month_after",
    "add_months",
    "round_money",
    "pct_change",
    "flat_multipliers",
    "compound_multipliers",
    "year_growth_pct",
    "by_year",
    "compound_factor",
    "flat_factor",
    "rate_of_year",
]
