"""DataFrame -> DataFrame operators; usable with ``df.transform``."""

from meterwise.operators.filters import (
    name_matches,
    in_date_range,
    for_account,
    positive_amount,
    keep_growth_at_least,
)
from meterwise.operators.windows import with_previous_amount
from meterwise.operators.topk import top_rows
from meterwise.operators.spine import with_month_spine, account_month_spine
from meterwise.operators.baselines import trailing_baseline, latest_month_baseline
from meterwise.operators.scenarios import flat_scenario, compound_scenario
from meterwise.operators.totals import totals_by

__all__ = [
    "name_matches",
    "in_date_range",
    "for_account",
    "positive_amount",
    "keep_growth_at_least",
    "with_previous_amount",
    "top_rows",
    "with_month_spine",
    "account_month_spine",
    "trailing_baseline",
    "latest_month_baseline",
    "flat_scenario",
    "compound_scenario",
    "totals_by",
]
