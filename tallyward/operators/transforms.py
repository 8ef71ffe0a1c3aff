"""Raw rows to the processed layer: one typed, cleaned table each.

``as_of`` stands in for today's date and ``run_ts`` for the clock, so a rerun gives the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.dates import age_years, hours_between
from tallyward.operators.dedupe import one_row_per_key
from tallyward.schemas import MONEY, RAW_COLUMNS


def typed(raw: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pick the known raw columns, rename and type them; text that does not parse becomes NULL."""
    return raw.select(*[
        F.col(header).try_cast(kind).alias(name) for header, (name, kind) in RAW_COLUMNS[table].items()
    ], *keep)


def _left_to_pay(cost: str, covered: str) -> Column:
    return (F.col(cost) - F.col(covered)).cast(MONEY)


def transform_patients(raw: DataFrame, as_of: dt.date, run_ts: dt.datetime) -> DataFrame:
    unique = one_row_per_key(typed(raw, "patients"), "patient_id")
    return unique.select(
        "*",
        age_years(F.col("birth_date"), F.lit(as_of)).alias("age_years"),
        F.col("death_date").isNotNull().alias("is_deceased"),
        F.lit(run_ts).alias("processed_at"),
    )


def transform_encounters(raw: DataFrame, as_of: dt.date, run_ts: dt.datetime) -> DataFrame:
    unique = one_row_per_key(typed(raw, "encounters"), "encounter_id")
    start, stop = F.col("encounter_start"), F.col("encounter_stop")
    return unique.select(
        "encounter_id", "patient_id", "provider_id", "payer_id",
        "encounter_class", "encounter_code", "description", start, stop,
        F.to_date(start).alias("encounter_date"),
        F.year(start).alias("encounter_year"),
        F.month(start).alias("encounter_month"),
        hours_between(start, stop).alias("duration_hours"),
        "base_cost", "total_claim_cost", "payer_coverage",
        _left_to_pay("total_claim_cost", "payer_coverage").alias("out_of_pocket"),
        F.lit(run_ts).alias("processed_at"),
    )


def transform_conditions(
    raw: DataFrame, as_of: dt.date, run_ts: dt.datetime, keep: tuple[str, ...] = ()
) -> DataFrame:
    """No key: repeated rows are separate diagnoses and stay. ``keep`` names extra columns to carry."""
    until = F.coalesce(F.col("resolution_date"), F.lit(as_of))
    return typed(raw, "conditions", keep).where(F.col("patient_id").isNotNull()).select(
        "patient_id", "encounter_id", "condition_code", "condition_description",
        "onset_date", "resolution_date",
        F.col("resolution_date").isNull().alias("is_chronic"),
        F.datediff(until, F.col("onset_date")).alias("days_active"),
        F.lit(run_ts).alias("processed_at"),
        *keep,
    )


def transform_medications(
    raw: DataFrame, as_of: dt.date, run_ts: dt.datetime, keep: tuple[str, ...] = ()
) -> DataFrame:
    """No key: repeated rows are separate prescriptions and stay. ``keep`` names extra columns to carry."""
    return typed(raw, "medications", keep).where(F.col("patient_id").isNotNull()).select(
        "patient_id", "encounter_id", "medication_code", "medication_description",
        "start_date", "stop_date",
        F.col("stop_date").isNull().alias("is_active"),
        "base_cost", "payer_coverage", "total_cost",
        _left_to_pay("total_cost", "payer_coverage").alias("out_of_pocket"),
        F.lit(run_ts).alias("processed_at"),
        *keep,
    )


TRANSFORMS = {
    "patients": transform_patients,
    "encounters": transform_encounters,
    "conditions": transform_conditions,
    "medications": transform_medications,
}
