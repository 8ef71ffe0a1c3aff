"""Marts kept up to date by changed days, and page figures from the rollup, against rebuilds."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, RUN_TS
from frames import raw
from tallyward.functions.money import as_double
from tallyward.operators import claims as c
from tallyward.operators import overview as o
from tallyward.operators.increments import merge_partials, newest_rows, patient_mart_of, patient_partials
from tallyward.operators.marts import claims_mart, patient_mart
from tallyward.operators.measures import claims_rollup
from tallyward.operators.staging import stage
from tallyward.operators.transforms import TRANSFORMS
from tallyward.plans.catalogue import QUERIES
from tallyward.plans.lake_marts import LakeMarts
from tallyward.plans.workspace import Workspace
from tallyward.schemas import CORE_TABLES
from tallyward.sources import zones as z

DAYS = [AS_OF - dt.timedelta(days=n) for n in range(4)]


def day_rows(seed):
    """Raw rows of one day: patients that other days know, unpriced and undated claims, unknown patients, NULL ids."""
    rng = random.Random(seed)
    who = [None, "nobody", *[f"p{n}" for n in range(9)]]
    patients = [{"Id": f"p{n}", "BIRTHDATE": dt.date(1950 + n, 1, 1), "GENDER": rng.choice("MF"), "STATE": rng.choice(["MA", "NY", None])}
                for n in rng.sample(range(9), 5)]
    encounters = [{
        "Id": f"e{seed}-{n}", "PATIENT": rng.choice(who), "PROVIDER": "x", "ENCOUNTERCLASS": rng.choice(["emergency", "wellness", None]),
        "START": rng.choice([None, dt.datetime(2001, rng.randint(1, 12), 3, 10)]),
        "TOTAL_CLAIM_COST": rng.choice([None, Decimal("0.00"), Decimal("12.34"), Decimal("7000.01")]),
        "PAYER_COVERAGE": rng.choice([None, Decimal("1.10")])} for n in range(30)]
    conditions = [{"PATIENT": rng.choice(who), "CODE": "c", "START": dt.date(2001, 1, 1), "STOP": rng.choice([None, dt.date(2001, 2, 1)])} for _ in range(12)]
    medications = [{"PATIENT": rng.choice(who), "CODE": "m", "START": dt.date(2001, 1, 1), "STOP": rng.choice([None, dt.date(2001, 2, 1)]),
                    "TOTALCOST": rng.choice([None, Decimal("3.30")])} for _ in range(12)]
    return {"patients": patients, "encounters": encounters, "conditions": conditions, "medications": medications}


def exact(frame):
    return frame.dtypes, sorted(map(repr, frame.collect()))


def test_marts_equal_a_rebuild_after_new_changed_relanded_empty_and_missing_days(spark, tmp_path):
    processed, root = str(tmp_path / "processed"), str(tmp_path / "marts")
    marts, held = LakeMarts(spark, processed, root), {}

    def land(day, rows):
        held[day] = {t: TRANSFORMS[t](raw(spark, t, rows[t]), AS_OF, RUN_TS) for t in rows}
        for table, frame in held[day].items():
            z.write_processed(frame, processed, table, day)

    def union(table):
        frames = [stage(f"stg_{table}", tables[table]) for tables in held.values() if table in tables]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def check():
        versions = [stage("stg_patients", tables["patients"]).withColumn("version", F.lit(day)) for day, tables in held.items() if "patients" in tables]
        people = versions[0]
        for frame in versions[1:]:
            people = people.unionByName(frame)
        people = newest_rows(people, "patient_id", "version")
        claims = claims_mart(union("encounters"), people)
        assert exact(marts.claims().select(*claims.columns)) == exact(claims)
        rebuilt = patient_mart(people, *[union(t) for t in ("encounters", "conditions", "medications")])
        assert exact(marts.patients()) == exact(rebuilt)
        assert exact(as_double(marts.rollup())) == exact(as_double(claims_rollup(claims)))

    land(DAYS[2], day_rows(1))
    marts.refresh([DAYS[2]])
    check()
    land(DAYS[1], day_rows(2))
    land(DAYS[0], {t: day_rows(3)[t] for t in ("encounters", "medications")})  # two tables did not come
    marts.refresh([DAYS[1], DAYS[0]])
    check()
    land(DAYS[2], day_rows(4))  # an old day comes again, with other rows
    marts.refresh([DAYS[2]])
    check()
    changed = day_rows(2)
    changed["patients"] = [{**row, "STATE": "TX"} for row in changed["patients"]]
    land(DAYS[1], changed)  # only patients change: the claims of other days follow
    written = marts.refresh([DAYS[1]])
    assert len(written) > 1
    check()
    land(DAYS[1], {t: [] for t in CORE_TABLES})
    marts.refresh([DAYS[1]])
    check()
    assert marts.refresh([]) == []


def test_a_lake_without_any_day(spark, tmp_path):
    marts = LakeMarts(spark, str(tmp_path / "processed"), str(tmp_path / "marts"))
    assert marts.claims().count() == marts.patients().count() == marts.rollup().count() == 0
    marts.refresh([AS_OF])
    assert marts.claims().count() == marts.patients().count() == marts.rollup().count() == 0


def test_partials_merge_in_any_grouping(spark):
    frames = [{t: TRANSFORMS[t](raw(spark, t, rows), AS_OF, RUN_TS) for t, rows in day_rows(n).items()} for n in range(3)]
    parts = [patient_partials(f["encounters"], f["conditions"], f["medications"]) for f in frames]
    two = merge_partials(parts[0].unionByName(parts[1]))
    one_way = merge_partials(two.unionByName(parts[2]))
    other = merge_partials(merge_partials(parts[2].unionByName(parts[1])).unionByName(parts[0]))
    assert exact(one_way) == exact(other)
    people = stage("stg_patients", frames[0]["patients"])
    assert patient_mart_of(people, one_way).count() == people.count()


PAGES = [c.claims_stats, c.cost_by_state, c.claims_kpis, c.claims_state_cost, c.class_coverage_split, c.claims_trend, c.claims_cards,
         o.overview_trend, o.cost_tier_counts, o.class_counts, o.age_group_costs, o.state_top12, o.tier_chart, o.age_chart]


@pytest.fixture(scope="module")
def claims(spark):
    frames = {t: TRANSFORMS[t](raw(spark, t, rows), AS_OF, RUN_TS) for t, rows in day_rows(9).items()}
    return claims_mart(stage("stg_encounters", frames["encounters"]), stage("stg_patients", frames["patients"]))


@pytest.mark.parametrize("page", PAGES, ids=lambda page: page.__name__)
def test_pages_from_the_rollup(claims, page):
    rollup = claims_rollup(claims)
    for left, right in ((claims, rollup), (claims.limit(0), claims_rollup(claims.limit(0)))):
        assert exact(page(left)) == exact(page(right))
    if page.__module__.endswith("claims") and page not in (c.claims_stats, c.cost_by_state):
        assert exact(page(claims, classes=["emergency"])) == exact(page(rollup, classes=["emergency"]))


def test_the_overview_needs_patients_beside_a_rollup(claims):
    assert exact(o.overview_kpis(claims_rollup(claims), claims)) == exact(o.overview_kpis(claims))
    with pytest.raises(ValueError):
        o.overview_kpis(claims_rollup(claims))


def test_pages_from_the_rollup_read_no_mart(ws):
    ws.rollup()
    for page in PAGES:
        files = page(ws.rollup()).inputFiles()
        assert files and all("claims_rollup" in f for f in files)


def test_the_lake_joins_each_raw_table_once(spark, sf_dir, tmp_path, monkeypatch):
    read = []
    raw = Workspace.raw
    monkeypatch.setattr(Workspace, "raw", lambda self, table: read.append(table) or raw(self, table))
    workspace = Workspace(spark, sf_dir, AS_OF, RUN_TS, str(tmp_path))
    try:
        assert QUERIES["incremental_rollup"](workspace).count() > 0
        assert sorted(read) == ["conditions", "encounters", "medications", "patients"]
    finally:
        workspace.close()
