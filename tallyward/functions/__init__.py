"""Column expressions: money arithmetic, buckets, dates and display text."""

from tallyward.functions.buckets import age_group, cost_tier
from tallyward.functions.dates import age_years, month_start
from tallyward.functions.labels import age_label, fmt_money, short_id, tier_label, whole_number
from tallyward.functions.money import as_double, mean, mean_ratio_pct, ratio_pct, total

__all__ = [
    "age_group", "age_label", "age_years", "as_double", "cost_tier", "fmt_money", "mean",
    "mean_ratio_pct", "month_start", "ratio_pct", "short_id", "tier_label", "total", "whole_number",
]
