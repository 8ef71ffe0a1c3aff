"""Patient listings, the point lookup and the filtered patient page."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.labels import fixed_point, whole_number
from tallyward.functions.money import as_double, mean
from tallyward.operators.filters import check_limit, eq_filters, in_filters, known

# Column headings of the detail table.
DETAIL_HEADINGS = {
    "patient_id": "Patient ID", "gender": "Gender", "race": "Race", "state": "State",
    "age_years": "Age", "age_group": "Age Group", "total_encounters": "Encounters",
    "total_claim_cost": "Total Cost ($)", "avg_claim_cost": "Avg Cost ($)",
    "total_out_of_pocket": "Total OOP ($)", "emergency_visits": "ER Visits",
    "chronic_conditions": "Chronic Conds", "active_medications": "Active Meds",
}


def _costliest_first(df: DataFrame, limit: int) -> DataFrame:
    rows = df.orderBy(F.desc_nulls_last("total_claim_cost"), "patient_id").limit(limit)
    return as_double(rows.select(*DETAIL_HEADINGS))


def patient_metrics(
    patients: DataFrame, limit: int = 50, age_group: str | None = None, state: str | None = None
) -> DataFrame:
    check_limit(limit, 1, 500)
    return _costliest_first(eq_filters(patients, age_group=age_group, state=state), limit)


def get_patient(patients: DataFrame, patient_id: str) -> DataFrame:
    """All mart columns of one patient; an empty frame when there is no such patient."""
    return as_double(patients.where(F.col("patient_id") == F.lit(patient_id)).limit(1))


def distinct_states(patients: DataFrame) -> DataFrame:
    return known(patients, "state").select("state").distinct().orderBy("state")


def page_selection(
    patients: DataFrame,
    states: Iterable[str] | None = None,
    ages: Iterable[str] | None = None,
    genders: Iterable[str] | None = None,
) -> DataFrame:
    """Patients of the chosen categories; an empty choice puts no condition at all."""
    return in_filters(patients, state=states, age_group=ages, gender=genders)


def patient_kpis(patients: DataFrame, **selection: Iterable[str] | None) -> DataFrame:
    with_emergency = F.try_divide(F.count_if(F.col("emergency_visits") > 0), F.count("*"))
    return page_selection(patients, **selection).agg(
        F.count("*").alias("total_patients"),
        mean("total_encounters", 1).alias("avg_encounters"),
        mean("chronic_conditions", 1).alias("avg_chronic"),
        mean("active_medications", 1).alias("avg_meds"),
        mean("total_claim_cost", 0).alias("avg_cost"),
        F.round(with_emergency * 100, 1).alias("pct_emergency"),
        mean("total_out_of_pocket", 0).alias("avg_oop"),
    )


def patients_by_race(patients: DataFrame, **selection: Iterable[str] | None) -> DataFrame:
    """The ten largest groups."""
    present = known(page_selection(patients, **selection), "race")
    return present.groupBy("race").agg(
        F.count("*").alias("patients"),
        mean("total_claim_cost", 0).alias("avg_cost"),
    ).orderBy(F.desc("patients"), "race").limit(10)


def age_distribution(patients: DataFrame, **selection: Iterable[str] | None) -> DataFrame:
    present = known(page_selection(patients, **selection), "age_years")
    return present.groupBy("age_years").agg(F.count("*").alias("n")).orderBy("age_years")


def age_histogram(patients: DataFrame, bins: int = 30, **selection: Iterable[str] | None) -> DataFrame:
    """Equal-width bins from the youngest to the oldest age; the oldest falls in the last bin.

    The window runs over the age distribution, one row per distinct age, not over patients.
    """
    whole = Window.partitionBy()
    low, high = F.min("age_years").over(whole), F.max("age_years").over(whole)
    ages = age_distribution(patients, **selection).select("age_years", "n", low.alias("low"), high.alias("high"))
    span = F.col("high") - F.col("low")
    position = F.coalesce(
        F.floor(F.try_divide((F.col("age_years") - F.col("low")) * bins, span)), F.lit(0))
    edge = lambda k: F.col("low") + k * span / bins
    binned = ages.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("bigint"))
    return binned.groupBy("bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end")).agg(
        F.sum("n").alias("patients")
    ).orderBy("bin")


def chronic_distribution(patients: DataFrame, **selection: Iterable[str] | None) -> DataFrame:
    present = known(page_selection(patients, **selection), "chronic_conditions")
    return present.groupBy("chronic_conditions").agg(F.count("*").alias("patients")).orderBy("chronic_conditions")


def patient_scatter(patients: DataFrame, **selection: Iterable[str] | None) -> DataFrame:
    """Eight hundred points for a chart: the first by patient id, so a redraw shows the same."""
    rows = page_selection(patients, **selection).orderBy("patient_id").limit(800)
    return as_double(rows.select(
        "patient_id", "age_group", "gender", "total_encounters", "total_claim_cost",
        "chronic_conditions", "active_medications", "emergency_visits",
    ))


def patient_detail(patients: DataFrame, limit: int = 100, **selection: Iterable[str] | None) -> DataFrame:
    check_limit(limit, 50, 500)
    return _costliest_first(page_selection(patients, **selection), limit)


def patient_detail_table(patients: DataFrame, limit: int = 100, **selection: Iterable[str] | None) -> DataFrame:
    """The detail rows under their display headings."""
    return patient_detail(patients, limit, **selection).withColumnsRenamed(DETAIL_HEADINGS)


def patient_cards(patients: DataFrame, **selection: Iterable[str] | None) -> DataFrame:
    return patient_kpis(patients, **selection).select(
        whole_number(F.col("total_patients")).alias("patients"),
        fixed_point(F.col("avg_encounters"), 1).alias("avg_encounters"),
        fixed_point(F.col("avg_chronic"), 1).alias("avg_chronic"),
        fixed_point(F.col("avg_meds"), 1).alias("avg_active_meds"),
        F.concat(F.lit("$"), whole_number(F.col("avg_cost"))).alias("avg_claim_cost"),
        F.concat(F.lit("$"), whole_number(F.col("avg_oop"))).alias("avg_out_of_pocket"),
        F.concat(fixed_point(F.col("pct_emergency"), 1), F.lit("%")).alias("with_emergency"),
    )
