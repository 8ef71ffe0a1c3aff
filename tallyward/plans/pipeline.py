"""The daily run, from source files to checked marts."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.quality import DECLARED_CHECKS, dq_report, validate_raw
from tallyward.operators.transforms import TRANSFORMS
from tallyward.plans.journal import Entry, Journal
from tallyward.schemas import CORE_TABLES, LANDED_TABLES
from tallyward.session import sized_shuffles
from tallyward.sources.manifest import landed, landing_manifest, write_manifest
from tallyward.sources.run_days import record_run_day
from tallyward.sources.warehouse import MARTS, create_staging_views, load_warehouse, materialize_marts
from tallyward.sources.zones import (
    Snapshot, all_raw_partitions_present, day_key, day_objects, discover_tables, land_raw, partition_status,
    raw_partition_present, read_csv, read_raw_partition, write_processed,
)

SUMMARY = "step STRING, table_name STRING, rows BIGINT, status STRING"


class Zones(NamedTuple):
    """Where a run reads and writes."""

    source: str
    raw: str
    processed: str
    warehouse: str
    database: str


def land_sources(spark: SparkSession, zones: Zones, run_date: dt.date, run_ts: dt.datetime,
                 project: str = "claims", origin: str = "ehr") -> tuple[list[Snapshot], list[str]]:
    """Land every source table that is there and write the manifest; names of the absent ones."""
    snapshots, missing = [], []
    for table, paths in discover_tables(spark, zones.source, LANDED_TABLES).items():
        if paths:
            snapshots.append(land_raw(read_csv(spark, *paths), zones.raw, table, run_date))
        else:
            missing.append(table)
    list_landed(spark, zones, snapshots, run_ts, project, origin)
    return snapshots, missing


def list_landed(spark: SparkSession, zones: Zones, snapshots: list[Snapshot], run_ts: dt.datetime,
                project: str = "claims", origin: str = "ehr") -> None:
    """The manifest of what has landed, if anything has."""
    if snapshots:
        write_manifest(landing_manifest(landed(spark, snapshots), run_ts, origin, project), zones.raw, run_ts)


def validate_landed(spark: SparkSession, zones: Zones, run_date: dt.date) -> DataFrame:
    """Raw checks of the four core tables for a day; an absent one is skipped."""
    days: dict[str, DataFrame | None] = {}
    for table in CORE_TABLES:
        try:
            days[table] = read_raw_partition(spark, zones.raw, table, run_date)
        except FileNotFoundError:
            days[table] = None
    return validate_raw(spark, days)


def transform_table(spark: SparkSession, zones: Zones, table: str, run_date: dt.date, as_of: dt.date,
                    run_ts: dt.datetime) -> Snapshot | None:
    """Transform one landed table into the processed zone; None if it did not land."""
    try:
        raw = read_raw_partition(spark, zones.raw, table, run_date)
    except FileNotFoundError:
        return None
    return write_processed(TRANSFORMS[table](raw, as_of, run_ts), zones.processed, table, run_date)


def transform_day(spark: SparkSession, zones: Zones, run_date: dt.date, as_of: dt.date,
                  run_ts: dt.datetime) -> tuple[list[Snapshot], list[str]]:
    """Transform every landed table into the processed zone; names of the absent ones."""
    record_run_day(spark, zones.processed, run_date, as_of)
    done = {table: transform_table(spark, zones, table, run_date, as_of, run_ts) for table in TRANSFORMS}
    return [s for s in done.values() if s], [table for table, s in done.items() if not s]


def checked_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    names = {name: f"{database}_marts.{name}" if name in MARTS else name for name in DECLARED_CHECKS}
    return {name: spark.table(place) for name, place in names.items()}


def _written(step: str, snapshot: Snapshot | None, table: str) -> list[Entry]:
    return [(step, table, snapshot.rows, "ok") if snapshot else (step, table, None, "skipped")]


def run_pipeline(spark: SparkSession, zones: Zones, run_date: dt.date, run_ts: dt.datetime,
                 as_of: dt.date | None = None, resume: bool = False) -> DataFrame:
    """Land, gate, transform, load, model and check one day; one summary row per step and table.

    Running a day again replaces that day and leaves the others. A core table that did not land
    stops the run at the gate; only the figures of the summary pass through the driver. With ``resume`` a run that
    stopped goes on behind the last table it finished, with the same summary; one that ended, or had another
    ``run_ts`` or ``as_of``, is run anew. The checks take what the writes have counted in passing; tables that an earlier attempt
    has written are scanned for it.
    """
    as_of = as_of or run_date
    journal = Journal(spark, zones.processed, run_date, {"run_ts": run_ts.isoformat(), "as_of": as_of.isoformat()}, resume)
    summary: list[Entry] = []
    watched: dict[str, dict[str, int]] = {}
    if not all(journal.done("land", table) for table in LANDED_TABLES):
        found = discover_tables(spark, zones.source, LANDED_TABLES)
        for table, paths in sorted(found.items(), key=lambda entry: not entry[1]):
            journal.step("land", table, lambda: _written(
                "land", land_raw(read_csv(spark, *paths), zones.raw, table, run_date) if paths else None, table))
    rows = [row for table in LANDED_TABLES for row in journal.step("land", table, list)]
    summary += sorted(rows, key=lambda row: row[3] == "skipped")
    snapshots = [Snapshot(table, n, 0, day_key(table, run_date)) for _, table, n, status in rows if status == "ok"]
    journal.step("list", "", lambda: list_landed(spark, zones, snapshots, run_ts) or [])
    summary += journal.step("validate", "", lambda: [
        ("validate", row.table_name, row.row_count, row.status.lower()) for row in validate_landed(spark, zones, run_date).collect()])
    landed_bytes = day_objects(spark, zones.raw, CORE_TABLES, run_date).agg(F.sum("bytes")).first()[0]
    raw_partition_present(spark, zones.raw, "patients", run_date)
    all_raw_partitions_present(spark, zones.raw, CORE_TABLES, run_date)
    with sized_shuffles(spark, landed_bytes or 0):
        record_run_day(spark, zones.processed, run_date, as_of)
        done = [journal.step("transform", table, lambda: _written(
            "transform", transform_table(spark, zones, table, run_date, as_of, run_ts), table)) for table in TRANSFORMS]
        summary += sorted((row for rows in done for row in rows), key=lambda row: row[3] == "skipped")
        for table in CORE_TABLES:
            summary += journal.step("load", table, lambda: [
                ("load", t, n, "ok")
                for t, n in load_warehouse(spark, zones.processed, zones.database, [table], run_date, zones.warehouse, watched).items()])
        create_staging_views(spark, zones.database)
        for mart in MARTS:
            summary += journal.step("model", mart, lambda: [
                ("model", name, n, "ok") for name, n in materialize_marts(
                    spark, zones.database, zones.warehouse, marts=[mart], watched=watched).items()])
        summary += journal.step("check", "", lambda: [
            ("check", f"{row.test} {row.table_name}.{row.column_name}", row.failing, "pass" if row.passed else "fail")
            for row in dq_report(checked_tables(spark, zones.database), watched).collect()])
    journal.end()
    return spark.createDataFrame(summary, SUMMARY)


def run_summary(spark: SparkSession, zones: Zones, run_date: dt.date) -> DataFrame:
    """One record of a day: raw objects, gate results and processed bytes per table."""
    raw = day_objects(spark, zones.raw, CORE_TABLES, run_date)
    sizes = day_objects(spark, zones.processed, CORE_TABLES, run_date).select("table_name", F.col("bytes").alias("processed"))
    gate = F.when(F.col("objects") > 0, "PASS").otherwise("FAIL")

    def per_table(value) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct("table_name", value))))

    return raw.join(sizes, "table_name", "left").agg(
        F.lit(run_date).alias("run_date"),
        F.max(F.when(F.col("table_name") == "patients", F.col("objects"))).alias("raw_object_count"),
        per_table(gate.alias("status")).alias("quality_results"),
        per_table("processed").alias("processed_sizes"),
    )
