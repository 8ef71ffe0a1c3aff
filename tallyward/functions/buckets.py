"""Cost tiers and age groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cost_tier(cost: Column) -> Column:
    """Exactly zero, under 500, under 5000, the rest. A NULL cost counts as the rest."""
    return (
        F.when(cost == 0, "zero_cost")
        .when(cost < 500, "low")
        .when(cost < 5000, "medium")
        .otherwise("high")
    )


def age_group(age: Column) -> Column:
    """Under 18, under 65, the rest. An unknown age counts as the rest."""
    return F.when(age < 18, "pediatric").when(age < 65, "adult").otherwise("senior")
