"""Display text built from Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels shown in place of the codes. The filter boxes write the adult range
# with an en dash, the overview chart with a hyphen.
TIER_LABELS = {"zero_cost": "Zero", "low": "Low (<$500)", "medium": "Medium (<$5k)", "high": "High (≥$5k)"}
AGE_LABELS = {"pediatric": "Pediatric (<18)", "adult": "Adult (18-64)", "senior": "Senior (65+)"}
AGE_FILTER_LABELS = {"pediatric": "Pediatric (<18)", "adult": "Adult (18–64)", "senior": "Senior (65+)"}


def _labelled(code: Column, labels: dict[str, str]) -> Column:
    """Label for a code; a code without one stands for itself."""
    lookup = F.create_map(*[F.lit(text) for pair in labels.items() for text in pair])
    return F.coalesce(F.try_element_at(lookup, code), code)


def tier_label(code: Column) -> Column:
    return _labelled(code, TIER_LABELS)


def age_label(code: Column, filter_box: bool = False) -> Column:
    return _labelled(code, AGE_FILTER_LABELS if filter_box else AGE_LABELS)


def short_id(identifier: Column) -> Column:
    return F.concat(F.substring(identifier, 1, 8), F.lit("..."))


def whole_number(value: Column) -> Column:
    """Fraction cut off, thousands separated."""
    return F.format_number(value.cast("bigint"), 0)


def fixed_point(value: Column, digits: int) -> Column:
    """Plain decimal text without separators."""
    return value.cast(f"decimal(20,{digits})").cast("string")


def fmt_money(amount: Column) -> Column:
    """Millions with one decimal and an M, thousands with a K, smaller amounts in full. NULL stays NULL."""
    amount = amount.cast("double")
    millions = F.format_string("$%.1fM", amount / 1_000_000)
    thousands = F.concat(F.lit("$"), F.bround(amount / 1_000, 0).cast("bigint").cast("string"), F.lit("K"))
    return (
        F.when(amount.isNull(), F.lit(None).cast("string"))
        .when(amount >= 1_000_000, millions)
        .when(amount >= 1_000, thousands)
        .otherwise(F.concat(F.lit("$"), F.format_number(amount, 0)))
    )
