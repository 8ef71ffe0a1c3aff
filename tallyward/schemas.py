"""Names, types and raw-column layouts shared by every layer."""

from __future__ import annotations

from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 2)

CORE_TABLES = ("patients", "encounters", "conditions", "medications")
# Tables the landing step looks for; besides the core ones two that are landed but never transformed.
LANDED_TABLES = (*CORE_TABLES, "procedures", "observations")

# Raw CSV header -> (processed column, type). Ids, ZIP and clinical codes stay text so that
# leading zeros and long codes survive.
RAW_COLUMNS: dict[str, dict[str, tuple[str, str]]] = {
    "patients": {
        "Id": ("patient_id", "string"),
        "BIRTHDATE": ("birth_date", "date"),
        "DEATHDATE": ("death_date", "date"),
        "GENDER": ("gender", "string"),
        "RACE": ("race", "string"),
        "ETHNICITY": ("ethnicity", "string"),
        "STATE": ("state", "string"),
        "ZIP": ("zip_code", "string"),
    },
    "encounters": {
        "Id": ("encounter_id", "string"),
        "PATIENT": ("patient_id", "string"),
        "PROVIDER": ("provider_id", "string"),
        "PAYER": ("payer_id", "string"),
        "ENCOUNTERCLASS": ("encounter_class", "string"),
        "CODE": ("encounter_code", "string"),
        "DESCRIPTION": ("description", "string"),
        "START": ("encounter_start", "timestamp"),
        "STOP": ("encounter_stop", "timestamp"),
        "BASE_ENCOUNTER_COST": ("base_cost", "decimal(18,2)"),
        "TOTAL_CLAIM_COST": ("total_claim_cost", "decimal(18,2)"),
        "PAYER_COVERAGE": ("payer_coverage", "decimal(18,2)"),
    },
    "conditions": {
        "PATIENT": ("patient_id", "string"),
        "ENCOUNTER": ("encounter_id", "string"),
        "CODE": ("condition_code", "string"),
        "DESCRIPTION": ("condition_description", "string"),
        "START": ("onset_date", "date"),
        "STOP": ("resolution_date", "date"),
    },
    "medications": {
        "PATIENT": ("patient_id", "string"),
        "ENCOUNTER": ("encounter_id", "string"),
        "CODE": ("medication_code", "string"),
        "DESCRIPTION": ("medication_description", "string"),
        "START": ("start_date", "date"),
        "STOP": ("stop_date", "date"),
        "BASE_COST": ("base_cost", "decimal(18,2)"),
        "PAYER_COVERAGE": ("payer_coverage", "decimal(18,2)"),
        "TOTALCOST": ("total_cost", "decimal(18,2)"),
    },
}

# The categories the marts and the page filters know.
ENCOUNTER_CLASSES = ("ambulatory", "emergency", "inpatient", "outpatient", "urgentcare", "wellness")
COST_TIERS = ("zero_cost", "low", "medium", "high")
AGE_GROUPS = ("pediatric", "adult", "senior")
GENDERS = ("M", "F")

OBJECT_CREATED_EVENT = (
    "Records ARRAY<STRUCT<s3: STRUCT<bucket: STRUCT<name: STRING>, "
    "object: STRUCT<key: STRING, size: STRING>>>>"
)
