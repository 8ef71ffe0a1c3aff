"""Headline figures over the whole claims mart, or over a rollup of it (``measures``) where no distinct count is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.dates import month_start
from tallyward.functions.labels import age_label, fixed_point, fmt_money, tier_label, whole_number
from tallyward.operators.filters import known
from tallyward.operators.measures import is_rollup, measures


def overview_kpis(claims: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """The distinct count has a subquery of its own: it shuffles bare patient ids, where counting
    next to the sums would carry every accumulator along with each patient.

    A rollup holds no patients: their ids (the mart) are then given as ``patients``.
    """
    m = measures(claims)
    if is_rollup(claims) and patients is None:
        raise ValueError("a rollup needs the rows whose patients are counted")
    distinct = (claims if patients is None else patients).agg(F.count_distinct("patient_id"))
    return claims.agg(
        m.count().alias("total_claims"),
        m.total("total_claim_cost", 0).alias("total_cost"),
        m.mean("total_claim_cost", 2).alias("avg_cost"),
        m.ratio_pct("payer_coverage", "total_claim_cost").alias("payer_pct"),
        m.mean("out_of_pocket", 2).alias("avg_oop"),
    ).select(
        "total_claims", distinct.scalar().alias("total_patients"), "total_cost", "avg_cost", "payer_pct", "avg_oop")


def overview_trend(claims: DataFrame) -> DataFrame:
    """Claims and billed amount per month; claims without a date form one NULL month."""
    m = measures(claims)
    by_month = claims.groupBy(month_start("encounter_year", "encounter_month").alias("month"))
    return by_month.agg(
        m.count().alias("claims"),
        m.total("total_claim_cost", 0).alias("total_cost"),
    ).orderBy(F.col("month").asc_nulls_first())


def cost_tier_counts(claims: DataFrame) -> DataFrame:
    m = measures(claims)
    return claims.groupBy("cost_tier").agg(m.count().alias("n"))


def class_counts(claims: DataFrame) -> DataFrame:
    m = measures(claims)
    present = known(claims, "encounter_class")
    return present.groupBy("encounter_class").agg(
        m.count().alias("claims"),
        m.mean("total_claim_cost", 0).alias("avg_cost"),
    ).orderBy(F.desc("claims"), "encounter_class")


def age_group_costs(claims: DataFrame) -> DataFrame:
    m = measures(claims)
    return known(claims, "age_group").groupBy("age_group").agg(
        m.count().alias("claims"),
        m.mean("total_claim_cost", 0).alias("avg_cost"),
        m.mean("out_of_pocket", 0).alias("avg_oop"),
    )


def gender_patients(patients: DataFrame) -> DataFrame:
    present = known(patients, "gender")
    return present.groupBy("gender").agg(F.count_distinct("patient_id").alias("patients"))


def state_top12(claims: DataFrame) -> DataFrame:
    m = measures(claims)
    return known(claims, "state").groupBy("state").agg(
        m.count().alias("claims"),
        m.total("total_claim_cost", 0).alias("total_cost"),
    ).orderBy(F.desc("claims"), "state").limit(12)


def live_counts(claims: DataFrame) -> DataFrame:
    """Row count and three exact distinct counts from one pass."""
    return claims.agg(
        F.count("*").alias("claims_rows"),
        F.count_distinct("patient_id").alias("patients"),
        F.count_distinct("provider_id").alias("providers"),
        F.count_distinct("state").alias("states"),
    )


def tier_chart(claims: DataFrame) -> DataFrame:
    """Cost tiers with their display labels."""
    return cost_tier_counts(claims).withColumn("label", tier_label(F.col("cost_tier")))


def age_chart(claims: DataFrame) -> DataFrame:
    """Age groups with their display labels, costliest first."""
    labelled = age_group_costs(claims).withColumn("label", age_label(F.col("age_group")))
    return labelled.orderBy(F.desc_nulls_last("avg_cost"), "age_group")


def overview_cards(claims: DataFrame) -> DataFrame:
    kpis = overview_kpis(claims)
    return kpis.select(
        whole_number(F.col("total_claims")).alias("total_claims"),
        whole_number(F.col("total_patients")).alias("unique_patients"),
        fmt_money(F.col("total_cost")).alias("total_billed"),
        F.concat(F.lit("$"), whole_number(F.col("avg_cost"))).alias("avg_claim_cost"),
        F.concat(fixed_point(F.col("payer_pct"), 1), F.lit("%")).alias("payer_coverage"),
        F.concat(F.lit("$"), whole_number(F.col("avg_oop"))).alias("avg_out_of_pocket"),
    )


def live_count_cards(claims: DataFrame) -> DataFrame:
    counts = live_counts(claims)
    return counts.select(*[whole_number(F.col(c)).alias(c) for c in counts.columns])
