import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, RUN_TS
from frames import CONDITIONS, ENCOUNTERS, M, MEDICATIONS, PATIENTS, T, raw, raw_text
from tallyward.functions.buckets import age_group, cost_tier
from tallyward.functions.dates import age_years
from tallyward.operators.dedupe import one_row_per_key
from tallyward.operators.transforms import (
    transform_conditions, transform_encounters, transform_medications, transform_patients,
)


def test_patients(spark):
    rows = {r.patient_id: r for r in transform_patients(raw(spark, "patients", PATIENTS), AS_OF, RUN_TS).collect()}
    assert set(rows) == {"a", "b", "c", "d"}
    assert rows["a"].age_years == (AS_OF - dt.date(1950, 1, 1)).days // 365
    assert rows["a"].zip_code == "02139" and rows["a"].is_deceased is False
    assert rows["b"].is_deceased is True and rows["b"].age_years == 22


def test_patient_schema(spark):
    df = transform_patients(raw(spark, "patients", PATIENTS), AS_OF, RUN_TS)
    assert [n for n, _ in df.dtypes] == [
        "patient_id", "birth_date", "death_date", "gender", "race", "ethnicity", "state", "zip_code",
        "age_years", "is_deceased", "processed_at"]
    assert dict(df.dtypes)["age_years"] == "bigint"


def test_age_counts_365_day_years(spark):
    born = spark.createDataFrame([(dt.date(2008, 12, 3),)], "b date")
    assert born.select(age_years(F.col("b"), F.lit(dt.date(2026, 12, 1)))).first()[0] == 18


def test_missing_keys_are_dropped_and_duplicates_resolved_the_same_way(spark):
    rows = [{"Id": None, "GENDER": "F"}, {"Id": "x", "GENDER": "M", "STATE": "B"}, {"Id": "x", "GENDER": "M", "STATE": "A"},
            {"Id": "y", "GENDER": "F"}]
    for order in (rows, rows[::-1]):
        out = transform_patients(raw(spark, "patients", order).repartition(3), AS_OF, RUN_TS)
        assert sorted((r.patient_id, r.state) for r in out.collect()) == [("x", "A"), ("y", None)]


def test_duplicate_encounters_keep_exactly_one(spark):
    twice = [ENCOUNTERS[1], ENCOUNTERS[1] | {"TOTAL_CLAIM_COST": M("7.00")}, {"Id": None, "PATIENT": "a"}]
    out = transform_encounters(raw(spark, "encounters", twice), AS_OF, RUN_TS).collect()
    assert [(r.encounter_id, r.total_claim_cost) for r in out] == [("e2", Decimal("7.00"))]


def test_encounter_measures(spark):
    rows = {r.encounter_id: r for r in transform_encounters(raw(spark, "encounters", ENCOUNTERS), AS_OF, RUN_TS).collect()}
    assert rows["e1"].duration_hours == 1.5
    assert rows["e2"].duration_hours is None
    assert rows["e3"].duration_hours == -1.0
    assert rows["e2"].out_of_pocket == Decimal("50.00")
    assert (rows["e4"].encounter_date, rows["e4"].encounter_year, rows["e4"].encounter_month) == (dt.date(2001, 5, 5), 2001, 5)
    assert rows["e5"].out_of_pocket == Decimal("499.99")


def test_conditions_keep_duplicates_and_run_open_ones_to_the_reference_day(spark):
    rows = transform_conditions(raw(spark, "conditions", CONDITIONS), AS_OF, RUN_TS).collect()
    assert sorted((r.condition_code, r.is_chronic, r.days_active) for r in rows) == [
        ("001", False, 10), ("001", False, 10), ("002", True, 30)]


def test_medications(spark):
    rows = transform_medications(raw(spark, "medications", MEDICATIONS + [{"CODE": "m9"}]), AS_OF, RUN_TS).collect()
    assert sorted((r.medication_code, r.is_active, r.out_of_pocket) for r in rows) == [
        ("m1", True, Decimal("2.30")), ("m2", False, Decimal("2.20"))]


def test_text_input_that_does_not_parse_becomes_null(spark):
    rows = [{"Id": "1", "PATIENT": "a", "START": "2011-07-05T17:51:49Z", "STOP": "soon", "TOTAL_CLAIM_COST": "12.345",
             "PAYER_COVERAGE": "n/a"}]
    row = transform_encounters(raw_text(spark, "encounters", rows), AS_OF, RUN_TS).first()
    assert row.encounter_date == dt.date(2011, 7, 5) and row.encounter_stop is None
    assert row.total_claim_cost == Decimal("12.35") and row.payer_coverage is None and row.out_of_pocket is None


def test_timestamps_are_cut_to_dates(spark):
    rows = [{"PATIENT": "a", "START": "2011-07-05T17:51:49Z", "STOP": "2011-07-06"}]
    row = transform_medications(raw_text(spark, "medications", rows), AS_OF, RUN_TS).first()
    assert (row.start_date, row.stop_date) == (dt.date(2011, 7, 5), dt.date(2011, 7, 6))


@pytest.mark.parametrize("cost, tier", [
    (None, "high"), ("-1", "low"), ("0", "zero_cost"), ("0.01", "low"), ("499.99", "low"), ("500", "medium"),
    ("4999.99", "medium"), ("5000", "high")])
def test_cost_tier_edges(spark, cost, tier):
    value = F.lit(cost).cast("decimal(18,2)")
    assert spark.range(1).select(cost_tier(value)).first()[0] == tier


@pytest.mark.parametrize("age, group", [
    (17, "pediatric"), (18, "adult"), (64, "adult"), (65, "senior"), (None, "senior")])
def test_age_group_edges(spark, age, group):
    assert spark.range(1).select(age_group(F.lit(age).cast("bigint"))).first()[0] == group


def test_one_row_per_key_against_brute_force(spark):
    rows = [(i % 7, i % 3, None if i % 5 == 0 else f"v{i % 11}", T(2001, 1, 1 + i % 20)) for i in range(500)]
    rows += [(None, 1, "v", T(2001, 1, 1))]
    df = spark.createDataFrame(rows, "k int, l int, v string, t timestamp").repartition(5)
    best = {}
    for k, l, v, t in rows:
        if k is not None:
            rank = (v is not None, v or "", t)
            if (k, l) not in best or rank < best[(k, l)][0]:
                best[(k, l)] = (rank, (k, l, v, t))
    out = sorted((tuple(r) for r in one_row_per_key(df, ["k", "l"]).collect()), key=repr)
    assert out == sorted((row for _, row in best.values()), key=repr)


def test_one_row_per_key_without_other_columns(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    assert sorted(r.k for r in one_row_per_key(df, "k").collect()) == [1, 2]


