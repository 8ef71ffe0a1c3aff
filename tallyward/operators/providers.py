"""Provider leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.labels import fixed_point, short_id, whole_number
from tallyward.functions.money import mean, mean_ratio_pct, total
from tallyward.operators.filters import check_limit, known

# What the leaderboard can be ranked by, and its column headings.
RANKINGS = {
    "Total Billed": "total_billed",
    "Total Claims": "total_claims",
    "Unique Patients": "unique_patients",
    "Avg Claim Cost": "avg_cost",
}
DETAIL_HEADINGS = {
    "rank": "#", "provider_id": "Provider ID", "total_claims": "Claims",
    "total_billed": "Total Billed ($)", "avg_cost": "Avg Cost ($)",
    "unique_patients": "Unique Patients", "total_payer_coverage": "Payer Coverage ($)",
    "total_oop": "Out-of-Pocket ($)",
}


def _with_provider(claims: DataFrame) -> DataFrame:
    return known(claims, "provider_id")


def _with_distincts(top: DataFrame, claims: DataFrame, **counted: str) -> DataFrame:
    """Add distinct counts to a row-limited list of providers.

    The list is broadcast with its figures: its row limit (at most 100) bounds it whatever the data. The claims
    of the listed providers are then grouped once, so the list itself is computed once. Counting spreads over
    (provider, value) before it comes together per provider, so a provider with a third of all claims does not
    land in one task.
    """
    theirs = claims.select("provider_id", *counted.values()).join(F.broadcast(top), "provider_id")
    return theirs.groupBy(*top.columns).agg(*[F.count_distinct(column).alias(name) for name, column in counted.items()])


def top_providers(claims: DataFrame, limit: int = 10) -> DataFrame:
    check_limit(limit, 1, 100)
    billed = [F.desc_nulls_last("total_billed"), F.col("provider_id")]
    top = _with_provider(claims).groupBy("provider_id").agg(
        F.count("*").alias("total_claims"),
        total("total_claim_cost", 2).alias("total_billed"),
        mean("total_claim_cost", 2).alias("avg_claim_cost"),
    ).orderBy(*billed).limit(limit)
    listed = _with_distincts(top, claims, unique_patients="patient_id")
    return listed.select(*top.columns, "unique_patients").orderBy(*billed)


def provider_leaderboard(claims: DataFrame, top_n: int = 25, metric: str = "Total Billed") -> DataFrame:
    """The top providers by billed amount, then ranked among themselves by ``metric``.

    The rank window sees at most ``top_n`` (50) rows.
    """
    check_limit(top_n, 10, 50)
    if metric not in RANKINGS:
        raise ValueError(f"metric must be one of {', '.join(RANKINGS)}")
    top = _with_provider(claims).groupBy("provider_id").agg(
        F.count("*").alias("total_claims"),
        total("total_claim_cost", 0).alias("total_billed"),
        mean("total_claim_cost", 0).alias("avg_cost"),
        total("payer_coverage", 0).alias("total_payer_coverage"),
        total("out_of_pocket", 0).alias("total_oop"),
    ).orderBy(F.desc_nulls_last("total_billed"), "provider_id").limit(top_n)
    listed = _with_distincts(top, claims, unique_patients="patient_id", encounter_types="encounter_class")
    order = Window.orderBy(F.desc_nulls_last(RANKINGS[metric]), "provider_id")
    return listed.select(
        *top.columns, "unique_patients", "encounter_types",
        F.row_number().over(order).alias("rank"), short_id(F.col("provider_id")).alias("short_id"),
    ).orderBy("rank")


def provider_detail_table(claims: DataFrame, top_n: int = 25, metric: str = "Total Billed") -> DataFrame:
    """The leaderboard under its display headings."""
    board = provider_leaderboard(claims, top_n, metric)
    return board.select(*DETAIL_HEADINGS).withColumnsRenamed(DETAIL_HEADINGS)


def provider_kpis(claims: DataFrame) -> DataFrame:
    """Network figures. The payer share here is the mean of the claims' own shares, unlike the
    ratio of sums shown elsewhere."""
    return _with_provider(claims).agg(
        F.count_distinct("provider_id").alias("total_providers"),
        mean("total_claim_cost", 0).alias("network_avg_cost"),
        total("total_claim_cost", 0).alias("network_total"),
        mean_ratio_pct("payer_coverage", "total_claim_cost").alias("network_payer_pct"),
    )


def provider_cards(claims: DataFrame) -> DataFrame:
    return provider_kpis(claims).select(
        whole_number(F.col("total_providers")).alias("total_providers"),
        F.concat(F.lit("$"), whole_number(F.col("network_total"))).alias("network_total"),
        F.concat(F.lit("$"), whole_number(F.col("network_avg_cost"))).alias("network_avg_cost"),
        F.concat(fixed_point(F.col("network_payer_pct"), 1), F.lit("%")).alias("network_payer_coverage"),
    )
