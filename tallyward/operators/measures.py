"""Counts and exact sums over claims, or over a rollup of them that holds the same counts and sums.

A rollup has one row per class, tier, age group, state and month with the number of claims and, for each amount, its exact decimal sum and
the number of claims that have it. Sums of such sums are the sums over the claims to the cent, so every figure made of
counts, sums, means and ratios of sums is the same from either; only distinct counts need the claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.money import mean, ratio_pct, total

DIMENSIONS = ("encounter_class", "cost_tier", "age_group", "state", "encounter_year", "encounter_month")
AMOUNTS = ("total_claim_cost", "payer_coverage", "out_of_pocket")


def claims_rollup(claims: DataFrame) -> DataFrame:
    """Partial sums combine on the map side, so a class or state that holds most claims still sends one row per task."""
    return claims.groupBy(*DIMENSIONS).agg(
        F.count("*").alias("n_claims"),
        *[f(a).alias(f"{kind}_{a}") for a in AMOUNTS for kind, f in (("sum", F.sum), ("n", F.count))])


def merge_rollups(rollups: DataFrame) -> DataFrame:
    """One rollup of several, as of one for each day."""
    return rollups.groupBy(*DIMENSIONS).agg(*[F.sum(c).alias(c) for c in rollups.columns if c not in DIMENSIONS])


def is_rollup(claims: DataFrame) -> bool:
    return "n_claims" in claims.columns


class OfClaims:
    """Aggregates over rows that are claims."""

    count = staticmethod(lambda: F.count("*"))
    total = staticmethod(total)
    mean = staticmethod(mean)
    ratio_pct = staticmethod(ratio_pct)


class OfRollup:
    """The same aggregates over rows of a rollup. A sum over no claims is NULL, their number 0."""

    @staticmethod
    def count() -> Column:
        return F.coalesce(F.sum("n_claims"), F.lit(0))

    @staticmethod
    def total(column: str, scale: int) -> Column:
        return total(f"sum_{column}", scale)

    @staticmethod
    def mean(column: str, scale: int) -> Column:
        exact = F.sum(f"sum_{column}").cast("decimal(28,2)")
        return F.round(F.try_divide(exact, F.sum(f"n_{column}")), scale).cast("double")

    @staticmethod
    def ratio_pct(part: str, whole: str, scale: int = 1) -> Column:
        return ratio_pct(f"sum_{part}", f"sum_{whole}", scale)


def measures(claims: DataFrame) -> type[OfClaims] | type[OfRollup]:
    return OfRollup if is_rollup(claims) else OfClaims
