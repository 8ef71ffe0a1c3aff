"""The two marts and the per-patient measures they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.buckets import age_group, cost_tier


def _described_claims(encounters: DataFrame, patients: DataFrame) -> DataFrame:
    """Every encounter once, with the patient's demographics where the patient is known.

    The join is left to Spark: broadcast when the patient side is measured small enough, else
    sort-merge. Both inputs are scans of written tables, so the exchanges sit right below
    the join and adaptive execution can split a patient id (or the NULL id) that holds a large
    share of the claims.
    """
    demographics = patients.select("patient_id", "gender", "race", "ethnicity", "state", "age_years")
    return encounters.join(demographics, "patient_id", "left").select(
        "encounter_id", "patient_id", "provider_id", "payer_id", "encounter_class",
        F.col("description").alias("encounter_description"),
        "encounter_date", "encounter_year", "encounter_month", "duration_hours",
        "total_claim_cost", "payer_coverage", "out_of_pocket",
        "gender", "race", "ethnicity", "state", "age_years",
    )


def _grouped_claims(described: DataFrame) -> DataFrame:
    return described.select(
        "*",
        cost_tier(F.col("total_claim_cost")).alias("cost_tier"),
        age_group(F.col("age_years")).alias("age_group"),
    )


def claims_mart(encounters: DataFrame, patients: DataFrame) -> DataFrame:
    """Every encounter once, with the patient's demographics where the patient is known, its cost tier and age group."""
    return _grouped_claims(_described_claims(encounters, patients))


def claims_mart_in_date_order(encounters: DataFrame, patients: DataFrame) -> DataFrame:
    """The claims mart ordered for writing. Tier and group follow from columns that are shuffled, so they are added behind that."""
    return _grouped_claims(in_date_order(_described_claims(encounters, patients)))


def in_date_order(claims: DataFrame) -> DataFrame:
    """Order for writing: each file holds a date range of its own and is sorted by date.

    A cutoff date then opens few files and few of their row groups. The id as second key splits a day, or the
    claims without a date, that would be too much for one file.
    """
    return claims.repartitionByRange("encounter_date", "encounter_id").sortWithinPartitions("encounter_date", "encounter_id")


def in_patient_order(patients: DataFrame) -> DataFrame:
    """Order for writing: each file holds a range of patient ids, so a point lookup opens one."""
    return patients.repartitionByRange("patient_id").sortWithinPartitions("patient_id")


def encounter_metrics(encounters: DataFrame) -> DataFrame:
    cost = F.sum("total_claim_cost")
    return encounters.groupBy("patient_id").agg(
        F.count("*").alias("total_encounters"),
        cost.alias("total_claim_cost"),
        F.try_divide(cost.cast("double"), F.count("total_claim_cost")).alias("avg_claim_cost"),
        F.sum("out_of_pocket").alias("total_out_of_pocket"),
        F.min("encounter_date").alias("first_encounter_date"),
        F.max("encounter_date").alias("last_encounter_date"),
        F.count_if(F.col("encounter_class") == "emergency").alias("emergency_visits"),
    )


def condition_metrics(conditions: DataFrame) -> DataFrame:
    return conditions.groupBy("patient_id").agg(
        F.count("*").alias("total_conditions"),
        F.count_if("is_chronic").alias("chronic_conditions"),
    )


def medication_metrics(medications: DataFrame) -> DataFrame:
    return medications.groupBy("patient_id").agg(
        F.count("*").alias("total_medications"),
        F.count_if("is_active").alias("active_medications"),
        F.sum("total_cost").alias("total_medication_cost"),
    )


def patient_mart(
    patients: DataFrame, encounters: DataFrame, conditions: DataFrame, medications: DataFrame
) -> DataFrame:
    """Every patient once, with measures that default to zero and dates that stay NULL.

    The three measure sets are aggregated by patient before the joins, so each side holds
    one row per patient and shares the same hash partitioning: one exchange per input.
    """
    def or_zero(*names: str) -> list:
        return [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]

    return (
        patients
        .join(encounter_metrics(encounters), "patient_id", "left")
        .join(condition_metrics(conditions), "patient_id", "left")
        .join(medication_metrics(medications), "patient_id", "left")
        .select(
            "patient_id", "gender", "race", "ethnicity", "state", "age_years",
            age_group(F.col("age_years")).alias("age_group"),
            "is_deceased",
            *or_zero("total_encounters", "total_claim_cost", "avg_claim_cost",
                     "total_out_of_pocket", "emergency_visits"),
            "first_encounter_date", "last_encounter_date",
            *or_zero("total_conditions", "chronic_conditions", "total_medications",
                     "active_medications", "total_medication_cost"),
        )
    )
