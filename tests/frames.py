"""Tiny input tables written by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tallyward.schemas import RAW_COLUMNS

D = dt.date
T = dt.datetime
M = Decimal


def raw(spark, table, rows):
    """A raw table from dictionaries; columns not given are NULL."""
    schema = ", ".join(f"`{header}` {kind}" for header, (_, kind) in RAW_COLUMNS[table].items())
    return spark.createDataFrame([tuple(r.get(h) for h in RAW_COLUMNS[table]) for r in rows], schema)


def raw_text(spark, table, rows):
    schema = ", ".join(f"`{header}` STRING" for header in RAW_COLUMNS[table])
    return spark.createDataFrame([tuple(r.get(h) for h in RAW_COLUMNS[table]) for r in rows], schema)


PATIENTS = [
    {"Id": "a", "BIRTHDATE": D(1950, 1, 1), "GENDER": "F", "RACE": "white", "ETHNICITY": "x", "STATE": "O'Brien", "ZIP": "02139"},
    {"Id": "b", "BIRTHDATE": D(1980, 1, 1), "DEATHDATE": D(2000, 5, 5), "GENDER": "M", "RACE": "black", "STATE": "MA", "ZIP": "00001"},
    {"Id": "c", "BIRTHDATE": D(1995, 1, 1), "GENDER": "F", "RACE": "asian", "STATE": "MA", "ZIP": "10001"},
    {"Id": "d", "BIRTHDATE": D(1990, 1, 1), "GENDER": "M", "RACE": "asian", "STATE": None, "ZIP": "10001"},
]


def _encounter(key, patient, cost, payer, kind="wellness", start=T(2001, 3, 4, 10), stop=T(2001, 3, 4, 11, 30), provider="prov-0001"):
    return {"Id": key, "PATIENT": patient, "PROVIDER": provider, "PAYER": "p1", "ENCOUNTERCLASS": kind, "CODE": "1",
            "DESCRIPTION": "visit", "START": start, "STOP": stop, "BASE_ENCOUNTER_COST": M("1.00"),
            "TOTAL_CLAIM_COST": cost, "PAYER_COVERAGE": payer}


ENCOUNTERS = [
    _encounter("e1", "a", M("0.00"), M("0.00"), "emergency"),
    _encounter("e2", "a", M("100.00"), M("50.00"), "Emergency", T(2001, 4, 4, 10), None),
    _encounter("e3", "b", M("300.00"), M("300.00"), "inpatient", T(2001, 4, 5, 10), T(2001, 4, 5, 9), "prov-0002"),
    _encounter("e4", "nobody", M("6000.00"), M("0.00"), "hospice", T(2001, 5, 5, 10), provider=None),
    _encounter("e5", "c", M("499.99"), M("0.00"), "outpatient", provider="prov-0002"),
]
CONDITIONS = [
    {"PATIENT": "a", "ENCOUNTER": "e1", "CODE": "001", "DESCRIPTION": "cold", "START": D(2001, 1, 1), "STOP": D(2001, 1, 11)},
    {"PATIENT": "a", "ENCOUNTER": "e1", "CODE": "001", "DESCRIPTION": "cold", "START": D(2001, 1, 1), "STOP": D(2001, 1, 11)},
    {"PATIENT": "a", "ENCOUNTER": "e2", "CODE": "002", "DESCRIPTION": "long", "START": D(2001, 12, 1), "STOP": None},
    {"PATIENT": None, "ENCOUNTER": "e9", "CODE": "003", "DESCRIPTION": "lost", "START": D(2001, 12, 1), "STOP": None},
]
MEDICATIONS = [
    {"PATIENT": "b", "ENCOUNTER": "e3", "CODE": "m1", "DESCRIPTION": "pill, \"blue\"", "START": D(2001, 1, 1), "STOP": None,
     "BASE_COST": M("1.10"), "PAYER_COVERAGE": M("1.00"), "TOTALCOST": M("3.30")},
    {"PATIENT": "b", "ENCOUNTER": "e3", "CODE": "m2", "DESCRIPTION": "pill", "START": D(2001, 1, 1), "STOP": D(2001, 2, 1),
     "BASE_COST": M("1.10"), "PAYER_COVERAGE": M("0.00"), "TOTALCOST": M("2.20")},
]
ROWS = {"patients": PATIENTS, "encounters": ENCOUNTERS, "conditions": CONDITIONS, "medications": MEDICATIONS}


def tables(spark, as_of, run_ts):
    """The processed tables of the rows above."""
    from tallyward.operators.transforms import TRANSFORMS

    return {t: transform(raw(spark, t, ROWS[t]), as_of, run_ts) for t, transform in TRANSFORMS.items()}
