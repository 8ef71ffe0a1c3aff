"""Per-patient measures of one day as rows that add up over days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.buckets import age_group

# What is measured, and how two rows of one patient become one.
_ADDED = ("encounters", "claim_cost", "priced", "out_of_pocket", "emergencies", "conditions", "chronic", "medications", "active", "medication_cost")
_MERGED = {**{c: F.sum for c in _ADDED}, "first_date": F.min, "last_date": F.max}
_SUM = "decimal(28,2)"


def _measured(rows: DataFrame, **measures: Column) -> DataFrame:
    return rows.where("patient_id is not null").groupBy("patient_id").agg(*[m.alias(name) for name, m in measures.items()])


def patient_partials(encounters: DataFrame, conditions: DataFrame, medications: DataFrame) -> DataFrame:
    """One row per patient of these rows. Each input is summed by patient first, so a patient with a third of all rows sends
    a few rows per task; the three then meet in one aggregate instead of two joins."""
    parts = [
        _measured(encounters, encounters=F.count("*"), claim_cost=F.sum("total_claim_cost"), priced=F.count("total_claim_cost"),
                  out_of_pocket=F.sum("out_of_pocket"), first_date=F.min("encounter_date"), last_date=F.max("encounter_date"),
                  emergencies=F.count_if(F.col("encounter_class") == "emergency")),
        _measured(conditions, conditions=F.count("*"), chronic=F.count_if("is_chronic")),
        _measured(medications, medications=F.count("*"), active=F.count_if("is_active"), medication_cost=F.sum("total_cost")),
    ]
    return merge_partials(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def merge_partials(partials: DataFrame) -> DataFrame:
    """One row per patient of the partials of several days; sums of exact decimals do not depend on their order."""
    merged = partials.groupBy("patient_id").agg(*[how(c).alias(c) for c, how in _MERGED.items()])
    return merged.withColumns({c: F.col(c).cast(_SUM) for c in ("claim_cost", "out_of_pocket", "medication_cost")})


def newest_rows(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the highest version, without the version. A maximum combines on the map side."""
    rest = [c for c in rows.columns if c not in (key, version)]
    newest = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return newest.select(key, *[f"_row.{c}" for c in rest])


def patient_mart_of(patients: DataFrame, measures: DataFrame) -> DataFrame:
    """The patient mart from merged partials: the columns, types and rows of ``patient_mart``."""
    def or_zero(value: Column, name: str) -> Column:
        return F.coalesce(value, F.lit(0)).alias(name)

    m = F.col
    return patients.join(measures, "patient_id", "left").select(
        "patient_id", "gender", "race", "ethnicity", "state", "age_years", age_group(m("age_years")).alias("age_group"), "is_deceased",
        or_zero(m("encounters"), "total_encounters"), or_zero(m("claim_cost"), "total_claim_cost"),
        or_zero(F.try_divide(m("claim_cost").cast("double"), m("priced")), "avg_claim_cost"),
        or_zero(m("out_of_pocket"), "total_out_of_pocket"), or_zero(m("emergencies"), "emergency_visits"),
        m("first_date").alias("first_encounter_date"), m("last_date").alias("last_encounter_date"),
        or_zero(m("conditions"), "total_conditions"), or_zero(m("chronic"), "chronic_conditions"),
        or_zero(m("medications"), "total_medications"), or_zero(m("active"), "active_medications"),
        or_zero(m("medication_cost"), "total_medication_cost"))
