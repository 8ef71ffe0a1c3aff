"""Listings by tasks, and checks that take what the writes have counted."""

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, RUN_TS
from frames import ROWS, raw
from tallyward.operators.quality import DECLARED_CHECKS, dq_report
from tallyward.operators.staging import STAGING_MODELS, stage
from tallyward.operators.transforms import TRANSFORMS
from tallyward.plans.pipeline import checked_tables
from tallyward.schemas import CORE_TABLES
from tallyward.sources import warehouse as w
from tallyward.sources import zones as z


def test_thousands_of_folders_are_listed_by_tasks(spark, tmp_path):
    for n in range(2000):
        folder = tmp_path / f"site{n % 50:02d}" / f"batch {n}"
        folder.mkdir(parents=True)
        (folder / ("Patients.csv" if n % 400 == 7 else "notes.txt")).write_text("Id\n1\n")
    (tmp_path / "patients.csv").write_text("Id\n1\n")
    (tmp_path / "site00" / "odd[1]{x}" / "PATIENTS.CSV").mkdir(parents=True)
    (tmp_path / "site00" / "odd[1]{x}" / "PATIENTS.CSV" / "part-0.csv").write_text("Id\n1\n")
    prefixes = z.listing_prefixes(spark, str(tmp_path))
    assert len(prefixes) == 51 and sum(p.endswith(".csv") for p in prefixes) == 1
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "one task for each prefix")
    found = z.discover_csv(spark, str(tmp_path), "patients")
    jobs = tracker.getJobIdsForGroup("listing")
    stages = [tracker.getStageInfo(s) for j in jobs for s in tracker.getJobInfo(j).stageIds]
    assert any(s and s.numTasks >= 50 for s in stages)
    spark.sparkContext._jsc.clearJobGroup()
    assert len(found) == 7 and sum("odd" in f for f in found) == 1


def test_folders_whose_names_are_patterns(spark, tmp_path):
    for name in ("a[1]", "b{2,3}", "c*", "plain"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "patients.csv").write_text("Id\n1\n")
    assert len(z.discover_csv(spark, str(tmp_path), "patients")) == 4


@pytest.fixture()
def loaded(spark, tmp_path):
    """Tables with faults of every kind, loaded and modelled with their counters."""
    rows = {t: [dict(r) for r in ROWS[t]] for t in CORE_TABLES}
    rows["patients"] += [{**rows["patients"][0], "Id": "x", "GENDER": "U"}, {**rows["patients"][0], "Id": "y", "GENDER": "?"},
                         {**rows["patients"][0], "Id": "w", "GENDER": "U", "BIRTHDATE": None}]
    rows["encounters"] += [{**rows["encounters"][0], "Id": "e8", "PATIENT": None, "TOTAL_CLAIM_COST": None}]
    rows["conditions"] += [{**rows["conditions"][0], "CODE": None}]
    for table in CORE_TABLES:
        frame = TRANSFORMS[table](raw(spark, table, rows[table]), AS_OF, RUN_TS)
        key = STAGING_MODELS[f"stg_{table}"][1]
        if table == "encounters":
            frame = frame.unionByName(frame.where(f"{key} = 'e1'")).unionByName(frame.where(f"{key} = 'e2'").withColumn(key, F.lit(None).cast("string")))
        z.write_processed(frame, str(tmp_path), table, AS_OF)
    watched = {}
    w.load_warehouse(spark, str(tmp_path), "counted", CORE_TABLES, AS_OF, str(tmp_path / "w"), watched)
    w.create_staging_views(spark, "counted")
    w.materialize_marts(spark, "counted", str(tmp_path / "w"), watched=watched)
    yield checked_tables(spark, "counted"), watched
    for database in ("counted", "counted_marts"):
        spark.sql(f"DROP DATABASE {database} CASCADE")


def scans(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("Relation spark_catalog")


def test_the_report_from_counters_equals_the_one_from_scans(loaded):
    tables, watched = loaded
    assert set(watched) == set(DECLARED_CHECKS)
    scanned, counted = dq_report(tables), dq_report(tables, watched)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, scanned.collect())) and counted.count() == 19
    assert counted.where("failing > 0").count() >= 5
    # Each column with accepted values had a scan of its own, tables without a key are not read at all.
    assert scans(scanned) == 9 and scans(counted) == 5
    assert scans(dq_report(tables, {"stg_conditions": watched["stg_conditions"]})) == 8


def test_unlisted_values_are_counted_once_each(spark, loaded):
    tables, watched = loaded
    assert watched["stg_patients"]["unlisted_gender"] == 3  # rows; the report counts different values
    row = dq_report(tables, watched).where("test = 'accepted_values' and table_name = 'stg_patients'").first()
    assert (row.failing, row.passed) == (2, False)
    assert stage("stg_patients", spark.table("counted.patients")).count() == tables["stg_patients"].count()
