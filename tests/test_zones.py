import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, RUN_TS
from frames import ROWS, raw
from tallyward.operators.quality import DECLARED_CHECKS
from tallyward.operators.transforms import TRANSFORMS
from tallyward.plans.pipeline import Zones, run_pipeline, run_summary, validate_landed
from tallyward.schemas import CORE_TABLES, LANDED_TABLES
from tallyward.session import shared_folder
from tallyward.sources import manifest as mf
from tallyward.sources import warehouse as w
from tallyward.sources import zones as z

NEXT_DAY = AS_OF + dt.timedelta(days=1)


def write_text(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


PATIENT_CSV = 'Id,BIRTHDATE,SSN,DEATHDATE,GENDER,RACE,ETHNICITY,STATE,ZIP\n"p1",1950-01-01,1,,F,white,x,"Mass, ""MA""",02139\np2,not a day,2,,M,black,y,NY,10001\n'


def test_discovery_ignores_case_and_depth(spark, tmp_path):
    write_text(tmp_path / "deep" / "er", "PATIENTS.csv", PATIENT_CSV)
    write_text(tmp_path, "patients.txt", "x")
    write_text(tmp_path, "old_patients.csv", "x")
    write_text(tmp_path / "other", "patients.csv", PATIENT_CSV)
    found = z.discover_csv(spark, str(tmp_path), "patients")
    assert [f.rsplit("/", 2)[1:] for f in found] == [["er", "PATIENTS.csv"], ["other", "patients.csv"]]
    assert z.read_csv(spark, *found).count() == 4  # every shard
    assert z.discover_csv(spark, str(tmp_path), "encounters") == []
    assert z.discover_csv(spark, str(tmp_path / "nowhere"), "patients") == []


def test_raw_csv_is_read_by_header_name(spark, tmp_path):
    write_text(tmp_path, "patients.csv", PATIENT_CSV)
    rows = {r.Id: r for r in z.read_raw_csv(
        spark, "patients", str(tmp_path / "patients.csv"), corrupt_column="_corrupt_record").collect()}
    assert rows["p1"].ZIP == "02139" and rows["p1"].STATE == 'Mass, "MA"' and rows["p1"]._corrupt_record is None
    assert rows["p1"].BIRTHDATE == dt.date(1950, 1, 1)
    assert rows["p2"].BIRTHDATE is None and "not a day" in rows["p2"]._corrupt_record


def test_files_with_different_headers_are_refused(spark, tmp_path):
    write_text(tmp_path, "a.csv", "Id,STATE\n1,MA\n2,NY\n")
    write_text(tmp_path, "b.csv", "STATE,Id\nMA,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        z.read_csv(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).collect()


def test_landing_a_day_twice_leaves_one_snapshot_and_other_days_alone(spark, tmp_path):
    root, df = str(tmp_path), raw(spark, "medications", ROWS["medications"])
    first = z.land_raw(df, root, "medications", AS_OF)
    assert first == z.Snapshot("medications", 2, 9, "medications/year=2001/month=12/day=31")
    z.land_raw(df, root, "medications", NEXT_DAY)
    z.land_raw(df.limit(1), root, "medications", AS_OF)
    assert z.read_raw_partition(spark, root, "medications", AS_OF).count() == 1
    assert z.read_raw_partition(spark, root, "medications", NEXT_DAY).count() == 2
    with pytest.raises(FileNotFoundError):
        z.read_raw_partition(spark, root, "medications", dt.date(1999, 1, 1))


def test_raw_round_trip_changes_nothing(spark, tmp_path):
    for table, transform in TRANSFORMS.items():
        df = raw(spark, table, ROWS[table])
        z.land_raw(df, str(tmp_path), table, AS_OF)
        back = z.read_raw_partition(spark, str(tmp_path), table, AS_OF)
        assert sorted(map(repr, transform(back, AS_OF, RUN_TS).collect())) == sorted(
            map(repr, transform(df, AS_OF, RUN_TS).collect()))


def test_processed_days_are_snappy_parquet_and_independent(spark, tmp_path):
    root = str(tmp_path)
    df = TRANSFORMS["encounters"](raw(spark, "encounters", ROWS["encounters"]), AS_OF, RUN_TS)
    assert z.write_processed(df, root, "encounters", AS_OF, max_records_per_file=2).rows == 5
    z.write_processed(df.limit(2), root, "encounters", NEXT_DAY)
    z.write_processed(df.limit(3), root, "encounters", AS_OF)
    assert z.read_processed_partition(spark, root, "encounters", AS_OF).count() == 3
    assert z.read_processed_partition(spark, root, "encounters", NEXT_DAY).count() == 2
    assert list(tmp_path.rglob("*.snappy.parquet"))
    assert z.read_processed_partition(spark, root, "encounters", AS_OF).dtypes == df.dtypes
    with pytest.raises(FileNotFoundError):
        z.read_processed_partition(spark, root, "patients", AS_OF)


def test_sizes_and_gates(spark, tmp_path):
    root = str(tmp_path)
    z.land_raw(raw(spark, "patients", ROWS["patients"]), root, "patients", AS_OF)
    sizes = {r.table_name: r.bytes for r in z.processed_sizes(spark, root, CORE_TABLES, AS_OF).collect()}
    on_disk = sum(f.stat().st_size for f in (tmp_path / "patients").rglob("part-*"))
    assert sizes == {"patients": on_disk, "encounters": 0, "conditions": 0, "medications": 0}
    assert z.raw_partition_present(spark, root, "patients", AS_OF) >= 1
    with pytest.raises(ValueError):
        z.raw_partition_present(spark, root, "encounters", AS_OF)
    assert z.all_raw_partitions_present(spark, root, ("patients",), AS_OF) == {"patients": "PASS"}
    with pytest.raises(ValueError, match="encounters, conditions, medications"):
        z.all_raw_partitions_present(spark, root, CORE_TABLES, AS_OF)


def test_manifest_document(spark, tmp_path):
    snapshots = [z.Snapshot("b", 5, 1, "b/k"), z.Snapshot("a", 7, 1, "a/k")]
    document = mf.landing_manifest(mf.landed(spark, snapshots), RUN_TS, "ehr", "claims")
    key = mf.write_manifest(document, str(tmp_path), RUN_TS)
    assert key == "_manifests/20011231_060000_manifest.json"
    row = spark.read.json(f"{tmp_path}/{key}").first()
    assert (row.total_tables, row.total_rows, row.source, row.project) == (2, 12, "ehr", "claims")
    assert [(t.table, t.rows, t.key) for t in row.tables] == [("a", 7, "a/k"), ("b", 5, "b/k")]
    absent = mf.missing_tables(spark, LANDED_TABLES, spark.createDataFrame([("patients",)], "table_name string"))
    assert {r.table_name for r in absent.collect()} == set(LANDED_TABLES) - {"patients"}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Two days of the whole pipeline over hand-written source files."""
    base = tmp_path_factory.mktemp("run")
    zones = Zones(*[str(base / n) for n in ("source", "raw", "processed", "warehouse")], "claims_run")
    for table in CORE_TABLES:
        raw(spark, table, ROWS[table]).write.options(**z.CSV_OPTIONS).csv(f"{zones.source}/in/{table.upper()}.csv")
    first = run_pipeline(spark, zones, AS_OF, RUN_TS).collect()
    run_pipeline(spark, zones, NEXT_DAY, RUN_TS, as_of=AS_OF)
    again = run_pipeline(spark, zones, AS_OF, RUN_TS).collect()
    return zones, first, again


def test_pipeline_summary(run):
    _, first, again = run
    assert first == again
    by_step = {}
    for r in first:
        by_step.setdefault(r.step, {})[r.table_name] = (r.rows, r.status)
    assert by_step["land"] == {
        "patients": (4, "ok"), "encounters": (5, "ok"), "conditions": (4, "ok"), "medications": (2, "ok"),
        "procedures": (None, "skipped"), "observations": (None, "skipped")}
    assert by_step["transform"]["conditions"] == (3, "ok")
    assert by_step["load"] == by_step["transform"]
    assert by_step["model"] == {"mart_claims_summary": (5, "ok"), "mart_patient_metrics": (4, "ok")}
    assert len(by_step["check"]) == 19 and {s for _, s in by_step["check"].values()} == {"pass"}


def test_pipeline_days_and_tables(spark, run):
    zones = run[0]
    assert z.read_processed_partition(spark, zones.processed, "encounters", NEXT_DAY).count() == 5
    assert spark.table("claims_run.encounters").count() == 5
    mart = spark.table("claims_run_marts.mart_patient_metrics")
    assert mart.where("patient_id = 'a'").first().total_claim_cost == Decimal("100.00")
    assert len(DECLARED_CHECKS) == 6


def test_run_summary_record(spark, run):
    row = run_summary(spark, run[0], AS_OF).first()
    assert row.raw_object_count >= 1 and row.quality_results == {t: "PASS" for t in CORE_TABLES}
    assert all(size > 0 for size in row.processed_sizes.values()) and len(row.processed_sizes) == 4


def test_catalog_picks_up_new_days(spark, run):
    zones = run[0]
    assert w.crawl_catalog(spark, "crawled", zones.raw, LANDED_TABLES, "csv") == list(CORE_TABLES)
    table = spark.table("crawled.encounters")
    assert table.groupBy("year", "month", "day").count().count() == 2
    z.land_raw(raw(spark, "encounters", ROWS["encounters"]), zones.raw, "encounters", dt.date(2002, 1, 5))
    w.crawl_catalog(spark, "crawled", zones.raw, LANDED_TABLES, "csv")
    assert spark.table("crawled.encounters").where("day = 5").count() == 5
    assert w.crawl_catalog(spark, "crawled_processed", zones.processed, CORE_TABLES, "parquet") == list(CORE_TABLES)


def test_cached_marts_and_refresh(spark, run):
    w.cache_marts(spark, "claims_run")
    assert spark.catalog.isCached("claims_run_marts.mart_claims_summary")
    w.refresh_marts(spark, "claims_run")
    assert not spark.catalog.isCached("claims_run_marts.mart_claims_summary")


def test_missing_core_table_stops_the_run_at_the_gate(spark, tmp_path):
    zones = Zones(*[str(tmp_path / n) for n in ("source", "raw", "processed", "warehouse")], "claims_gate")
    raw(spark, "patients", ROWS["patients"]).write.options(**z.CSV_OPTIONS).csv(f"{zones.source}/patients.csv")
    with pytest.raises(ValueError, match="encounters"):
        run_pipeline(spark, zones, AS_OF, RUN_TS)
    status = {r.table_name: r.status for r in validate_landed(spark, zones, AS_OF).collect()}
    assert status == {"patients": "PASS", "encounters": "SKIP", "conditions": "SKIP", "medications": "SKIP"}


def test_bucketed_patient_mart_opens_one_bucket(spark, run):
    mart = spark.table("claims_run_marts.mart_patient_metrics")
    w.replace_table(mart, "claims_run_marts", "by_patient", run[0].warehouse, (4, "patient_id"))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # shows the bucket count
    try:
        lookup = spark.table("claims_run_marts.by_patient").where(F.col("patient_id") == "a")
        plan = lookup._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 4" in plan and lookup.count() == 1
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_an_empty_snapshot_replaces_the_day(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "Id string, n int")
    for write, read in ((z.land_raw, z.read_raw_partition), (z.write_processed, z.read_processed_partition)):
        root = str(tmp_path / write.__name__)
        other = dt.date(2024, 1, 5)
        write(df, root, "t", other)
        for n in (2, 0):
            assert write(df.limit(n), root, "t", dt.date(2024, 1, 6)).rows == n
            day = read(spark, root, "t", dt.date(2024, 1, 6))
            assert (day.count(), day.columns) == (n, df.columns)
        assert read(spark, root, "t", other).count() == 2
    from tallyward.operators.quality import validate_raw

    landed = z.read_raw_partition(spark, str(tmp_path / "land_raw"), "t", dt.date(2024, 1, 6))
    row = validate_raw(spark, {"t": landed}).first()
    assert (row.status, row.has_rows, row.row_count) == ("FAIL", False, 0)


def test_a_crawl_adds_new_columns(spark, tmp_path):
    from tallyward.sources import warehouse as w

    for file_format, write in (("parquet", z.write_processed), ("csv", z.land_raw)):
        root, database = str(tmp_path / file_format), f"grown_{file_format}"
        write(spark.createDataFrame([("a",)], "Id string"), root, "t", dt.date(2024, 1, 5))
        w.crawl_catalog(spark, database, root, ["t"], file_format)
        write(spark.createDataFrame([("b", "new")], "Id string, extra string"), root, "t", dt.date(2024, 1, 6))
        w.crawl_catalog(spark, database, root, ["t"], file_format)
        assert sorted(map(tuple, spark.table(f"{database}.t").select("Id", "extra", "day").collect())) == [("a", None, 5), ("b", "new", 6)]
        spark.sql(f"DROP DATABASE {database} CASCADE")


def test_landed_days_are_compressed_and_cut_into_files_that_tasks_share(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(z.CSV_WRITE_OPTIONS, "maxRecordsPerFile", "40")
    rows = [(str(i), f'say "{i}", or\tnot' if i % 3 else None) for i in range(100)]
    landed = z.land_raw(spark.createDataFrame(rows, "Id string, STATE string").coalesce(1), str(tmp_path), "patients", AS_OF)
    files = list(tmp_path.rglob("part-*"))
    assert len(files) == 3 and all(f.name.endswith(".csv.gz") for f in files) and landed.rows == 100
    back = z.read_raw_partition(spark, str(tmp_path), "patients", AS_OF)
    assert sorted(map(tuple, back.collect()), key=lambda r: int(r[0])) == rows
