"""Staging models: fixed column lists over the processed tables, keys present."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Model name -> (source table, key that must be present, columns).
STAGING_MODELS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "stg_patients": ("patients", "patient_id", (
        "patient_id", "birth_date", "death_date", "gender", "race", "ethnicity", "state",
        "zip_code", "age_years", "is_deceased", "processed_at")),
    "stg_encounters": ("encounters", "encounter_id", (
        "encounter_id", "patient_id", "provider_id", "payer_id", "encounter_class",
        "encounter_code", "description", "encounter_start", "encounter_stop", "encounter_date",
        "encounter_year", "encounter_month", "duration_hours", "base_cost", "total_claim_cost",
        "payer_coverage", "out_of_pocket", "processed_at")),
    "stg_conditions": ("conditions", "patient_id", (
        "patient_id", "encounter_id", "condition_code", "condition_description", "onset_date",
        "resolution_date", "is_chronic", "days_active", "processed_at")),
    "stg_medications": ("medications", "patient_id", (
        "patient_id", "encounter_id", "medication_code", "medication_description", "start_date",
        "stop_date", "is_active", "base_cost", "payer_coverage", "total_cost", "out_of_pocket",
        "processed_at")),
}


def stage(model: str, source: DataFrame) -> DataFrame:
    _, key, columns = STAGING_MODELS[model]
    return source.where(F.col(key).isNotNull()).select(*columns)
