import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, RUN_TS
from frames import raw, tables
from tallyward.operators.marts import claims_mart, patient_mart
from tallyward.operators.quality import (
    dq_accepted_values, dq_not_null, dq_report, dq_unique, validate_raw, watched_counters,
)


@pytest.fixture(scope="module")
def clean(spark):
    t = tables(spark, AS_OF, RUN_TS)
    models = {f"stg_{name}": df for name, df in t.items()}
    models["mart_claims_summary"] = claims_mart(t["encounters"], t["patients"])
    models["mart_patient_metrics"] = patient_mart(*[t[n] for n in ("patients", "encounters", "conditions", "medications")])
    return {name: df.cache() for name, df in models.items()}


def failed(report):
    return {r.check_name: r.failing for r in report.collect() if not r.passed}


def test_all_nineteen_pass_on_clean_tables(clean):
    rows = dq_report(clean).collect()
    assert len(rows) == 19 and all(r.passed and r.failing == 0 for r in rows)
    tally = {}
    for r in rows:
        tally[r.table_name] = tally.get(r.table_name, 0) + 1
    assert tally == {"stg_patients": 5, "stg_encounters": 4, "stg_conditions": 2, "stg_medications": 2,
                     "mart_claims_summary": 4, "mart_patient_metrics": 2}


NULL_CHECKS = [("stg_patients", "patient_id"), ("stg_patients", "gender"), ("stg_patients", "age_years"),
               ("stg_encounters", "encounter_id"), ("stg_encounters", "patient_id"),
               ("stg_encounters", "total_claim_cost"), ("stg_conditions", "patient_id"),
               ("stg_conditions", "condition_code"), ("stg_medications", "patient_id"),
               ("stg_medications", "medication_code"), ("mart_claims_summary", "encounter_id"),
               ("mart_patient_metrics", "patient_id")]


@pytest.mark.parametrize("table, column", NULL_CHECKS)
def test_nulls_fail_that_check_alone(clean, table, column):
    df = clean[table]
    broken = clean | {table: df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))}
    assert failed(dq_report(broken)) == {f"not_null {table}.{column}": df.count()}


@pytest.mark.parametrize("table, column", [
    ("stg_patients", "patient_id"), ("stg_encounters", "encounter_id"), ("mart_claims_summary", "encounter_id"),
    ("mart_patient_metrics", "patient_id")])
def test_a_repeated_key_fails_that_check_alone(clean, table, column):
    df = clean[table]
    broken = clean | {table: df.unionByName(df.limit(1))}
    assert failed(dq_report(broken)) == {f"unique {table}.{column}": 1}


@pytest.mark.parametrize("table, column", [
    ("stg_patients", "gender"), ("mart_claims_summary", "cost_tier"), ("mart_claims_summary", "age_group")])
def test_an_unlisted_value_fails_that_check_alone(clean, table, column):
    broken = clean | {table: clean[table].withColumn(column, F.lit("odd"))}
    assert failed(dq_report(broken)) == {f"accepted_values {table}.{column}": 1}


def test_counted_checks_come_in_the_order_of_scanned_ones(clean):
    watched = {}
    for table, df in clean.items():
        counters = watched_counters(table)
        watched[table] = df.agg(*[value.alias(name) for name, value in counters.items()]).first().asDict()
    assert dq_report(clean, watched).collect() == dq_report(clean).collect()


def test_single_checks(spark):
    df = spark.createDataFrame([("a", "M"), ("a", None), (None, "X"), (None, "X"), ("b", "F")], "k string, g string")
    assert [tuple(r) for r in dq_unique(df, "k").collect()] == [("a", 2)]
    assert tuple(dq_not_null(df, "k", "g").first()) == (2, 1)
    assert [tuple(r) for r in dq_accepted_values(df, "g", ["M", "F"]).collect()] == [("X", 2)]


def test_raw_check(spark):
    some = raw(spark, "conditions", [{"PATIENT": "a"}])
    none = raw(spark, "patients", [])
    blank = spark.createDataFrame([(1, 2)], ["a", " "])
    rows = {r.table_name: r for r in validate_raw(
        spark, {"conditions": some, "patients": none, "blank": blank, "absent": None}).collect()}
    assert {k: r.status for k, r in rows.items()} == {
        "conditions": "PASS", "patients": "FAIL", "blank": "FAIL", "absent": "SKIP"}
    assert rows["patients"].has_rows is False and rows["blank"].no_empty_cols is False and rows["conditions"].row_count == 1
