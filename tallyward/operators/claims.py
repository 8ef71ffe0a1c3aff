"""Claim listings, claim statistics and the filtered claims page.

Figures take the claims mart or a rollup of it (``measures``); listings take the mart.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.dates import month_start
from tallyward.functions.labels import fixed_point, whole_number
from tallyward.functions.money import as_double
from tallyward.operators.filters import check_limit, eq_filters, in_filters, known
from tallyward.operators.measures import measures
from tallyward.schemas import AGE_GROUPS, COST_TIERS, ENCOUNTER_CLASSES

# Column headings of the detail table.
DETAIL_HEADINGS = {
    "encounter_id": "Encounter ID", "encounter_class": "Class", "encounter_date": "Date",
    "state": "State", "age_group": "Age Group", "gender": "Gender",
    "total_claim_cost": "Total Cost ($)", "payer_coverage": "Payer Coverage ($)",
    "out_of_pocket": "Out-of-Pocket ($)", "cost_tier": "Cost Tier",
}


def _newest_first(df: DataFrame, limit: int) -> DataFrame:
    """Top rows by date with the claim id as tie-break, undated claims last.

    The day that completes the limit is found first, from a count per day. As a pushed-down
    condition it lets the scan skip the row groups of older claims (the mart is written in date
    order within each file), and tasks without a candidate send nothing to the final merge. The
    window runs over at most ``limit`` days.
    """
    day = F.col("encounter_date")
    newest_days = known(df, "encounter_date").groupBy(day).agg(F.count("*").alias("n")).orderBy(day.desc()).limit(limit)
    newer = F.sum("n").over(Window.orderBy(day.desc()).rowsBetween(Window.unboundedPreceding, -1))
    needed = newest_days.select(day, F.coalesce(newer, F.lit(0)).alias("newer")).where(F.col("newer") < limit)
    cutoff = needed.agg(F.min(day)).scalar()
    candidates = df.where((day >= cutoff) | day.isNull())
    return candidates.orderBy(day.desc_nulls_last(), "encounter_id").limit(limit)


def claims_summary(
    claims: DataFrame,
    limit: int = 100,
    encounter_class: str | None = None,
    cost_tier: str | None = None,
    age_group: str | None = None,
) -> DataFrame:
    check_limit(limit, 1, 1000)
    wanted = eq_filters(claims, encounter_class=encounter_class, cost_tier=cost_tier, age_group=age_group)
    return as_double(_newest_first(wanted, limit).select(
        "encounter_id", "patient_id", "encounter_class", "encounter_date", "total_claim_cost",
        "payer_coverage", "out_of_pocket", "cost_tier", "age_group", "gender", "state",
    ))


def claims_stats(claims: DataFrame) -> DataFrame:
    """Counts and costs per encounter class, cost tier and age group, largest group first."""
    m = measures(claims)
    groups = ["encounter_class", "cost_tier", "age_group"]
    return claims.groupBy(*groups).agg(
        m.count().alias("total_claims"),
        m.mean("total_claim_cost", 2).alias("avg_cost"),
        m.total("total_claim_cost", 2).alias("total_cost"),
        m.mean("out_of_pocket", 2).alias("avg_out_of_pocket"),
    ).orderBy(F.desc("total_claims"), *groups)


def cost_by_state(claims: DataFrame) -> DataFrame:
    m = measures(claims)
    return known(claims, "state").groupBy("state").agg(
        m.count().alias("total_claims"),
        m.total("total_claim_cost", 2).alias("total_cost"),
        m.mean("total_claim_cost", 2).alias("avg_cost"),
        m.mean("out_of_pocket", 2).alias("avg_out_of_pocket"),
    ).orderBy(F.desc_nulls_last("total_cost"), "state")


def page_selection(
    claims: DataFrame,
    classes: Iterable[str] | None = None,
    tiers: Iterable[str] | None = None,
    ages: Iterable[str] | None = None,
) -> DataFrame:
    """Claims of the chosen categories. An empty choice means every *listed* category, so
    claims of an unlisted or NULL class are left out even then."""
    return in_filters(
        claims,
        encounter_class=list(classes or ENCOUNTER_CLASSES),
        cost_tier=list(tiers or COST_TIERS),
        age_group=list(ages or AGE_GROUPS),
    )


def claims_kpis(claims: DataFrame, **selection: Iterable[str] | None) -> DataFrame:
    m = measures(claims)
    return page_selection(claims, **selection).agg(
        m.count().alias("claims"),
        m.mean("total_claim_cost", 2).alias("avg_cost"),
        m.ratio_pct("payer_coverage", "total_claim_cost").alias("payer_pct"),
        m.mean("out_of_pocket", 2).alias("avg_oop"),
        m.total("total_claim_cost", 0).alias("total_cost"),
    )


def claims_state_cost(claims: DataFrame, **selection: Iterable[str] | None) -> DataFrame:
    """The fifteen states with the highest billed amount."""
    m = measures(claims)
    present = known(page_selection(claims, **selection), "state")
    return present.groupBy("state").agg(
        m.count().alias("claims"),
        m.total("total_claim_cost", 0).alias("total_cost"),
        m.mean("total_claim_cost", 0).alias("avg_cost"),
        m.mean("out_of_pocket", 0).alias("avg_oop"),
    ).orderBy(F.desc_nulls_last("total_cost"), "state").limit(15)


def class_coverage_split(claims: DataFrame, **selection: Iterable[str] | None) -> DataFrame:
    m = measures(claims)
    return page_selection(claims, **selection).groupBy("encounter_class").agg(
        m.mean("payer_coverage", 0).alias("avg_payer"),
        m.mean("out_of_pocket", 0).alias("avg_oop"),
    ).orderBy(F.desc_nulls_last("avg_payer"), "encounter_class")


def claims_trend(claims: DataFrame, **selection: Iterable[str] | None) -> DataFrame:
    m = measures(claims)
    by_month = page_selection(claims, **selection).groupBy(
        month_start("encounter_year", "encounter_month").alias("month"))
    return by_month.agg(
        m.count().alias("claims"),
        m.mean("total_claim_cost", 0).alias("avg_cost"),
    ).orderBy(F.col("month").asc_nulls_first())


def claims_detail(claims: DataFrame, limit: int = 200, **selection: Iterable[str] | None) -> DataFrame:
    check_limit(limit, 50, 1000)
    rows = _newest_first(page_selection(claims, **selection), limit)
    return as_double(rows.select(*DETAIL_HEADINGS))


def claims_detail_table(claims: DataFrame, limit: int = 200, **selection: Iterable[str] | None) -> DataFrame:
    """The detail rows under their display headings."""
    return claims_detail(claims, limit, **selection).withColumnsRenamed(DETAIL_HEADINGS)


def claims_cards(claims: DataFrame, **selection: Iterable[str] | None) -> DataFrame:
    return claims_kpis(claims, **selection).select(
        whole_number(F.col("claims")).alias("claims"),
        F.concat(F.lit("$"), whole_number(F.col("total_cost"))).alias("total_billed"),
        F.concat(F.lit("$"), F.format_number("avg_cost", 2)).alias("avg_cost"),
        F.concat(fixed_point(F.col("payer_pct"), 1), F.lit("%")).alias("payer_coverage"),
        F.concat(F.lit("$"), F.format_number("avg_oop", 2)).alias("avg_out_of_pocket"),
    )
