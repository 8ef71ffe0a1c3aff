"""Every operator as a named query over one workspace."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.buckets import age_group, cost_tier
from tallyward.functions.labels import age_label, fmt_money, short_id, tier_label
from tallyward.functions.money import as_double
from tallyward.operators import claims as c
from tallyward.operators import marts as m
from tallyward.operators import overview as o
from tallyward.operators import patients as p
from tallyward.operators import providers as v
from tallyward.operators import quality as q
from tallyward.operators.dedupe import one_row_per_key
from tallyward.operators.filters import eq_filters, in_filters, known
from tallyward.operators.staging import STAGING_MODELS
from tallyward.operators.transforms import TRANSFORMS, typed
from tallyward.plans.lake_marts import LakeMarts
from tallyward.plans.pipeline import Zones, checked_tables, run_pipeline, run_summary, transform_day
from tallyward.plans.workspace import Workspace
from tallyward.schemas import CORE_TABLES, GENDERS, LANDED_TABLES
from tallyward.sources import manifest as mf
from tallyward.sources import warehouse as w
from tallyward.sources import zones as z
from tallyward.sources.export import envelope, with_total
from tallyward.sources.star_schema import object_notifications, star_table
from tallyward.streaming.alarm import AlarmSums, ingest_error_alarm, start_error_sums
from tallyward.streaming.events import (
    failed_notifications, handled_failures, handled_log, ingest_batch_summary, ingest_errors, ingest_event_log, log_lines,
    read_notifications, start_event_handling, start_event_log,
)
from tallyward.streaming.landing import start_incremental_landing

Query = Callable[[Workspace], DataFrame]

# Parameters of the filtered queries; the check texts use the same ones.
CLAIM_CHOICE = {"classes": ["emergency", "inpatient"], "tiers": ["medium", "high"], "ages": ["adult", "senior"]}
NO_CLAIM = {"classes": ["O'Brien"]}
PATIENT_CHOICE = {"states": ["NATION_3", "NATION_7", "NATION_11"], "ages": ["adult"], "genders": ["F"]}
NO_PATIENT = {"states": ["O'Brien"]}
SOURCE_TAG, PROJECT = "ehr", "claims"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _raw(ws: Workspace) -> dict[str, DataFrame]:
    return {table: ws.raw(table) for table in CORE_TABLES}


def _counted(ws: Workspace, rows: dict[str, int]) -> DataFrame:
    return ws.spark.createDataFrame(list(rows.items()), "table_name STRING, n_rows BIGINT")


def _write_sources(ws: Workspace, root: str, tables: tuple[str, ...] = CORE_TABLES) -> str:
    """Source extracts of the given tables, as the landing step finds them."""
    for table in tables:
        ws.raw(table).write.options(**z.CSV_WRITE_OPTIONS).mode("overwrite").csv(f"{root}/extracts/{table.title()}.csv")
    return root


def _landed(ws: Workspace, tables: tuple[str, ...] = CORE_TABLES) -> tuple[Zones, list[z.Snapshot]]:
    def land() -> tuple[Zones, list[z.Snapshot]]:
        zones = ws.zones(_database())
        return zones, [z.land_raw(ws.raw(t), zones.raw, t, ws.as_of) for t in tables]

    return ws.once(f"land {tables}", land)


def _transformed(ws: Workspace) -> tuple[Zones, list[z.Snapshot]]:
    zones, _ = _landed(ws)
    return zones, ws.once("transform", lambda: transform_day(ws.spark, zones, ws.as_of, ws.as_of, ws.run_ts))[0]


def _loaded(ws: Workspace) -> tuple[Zones, dict[str, int]]:
    zones, _ = _transformed(ws)
    return zones, ws.once("load", lambda: w.load_warehouse(
        ws.spark, zones.processed, zones.database, CORE_TABLES, ws.as_of, zones.warehouse))


def _modelled(ws: Workspace) -> tuple[Zones, dict[str, int]]:
    zones, _ = _loaded(ws)
    w.create_staging_views(ws.spark, zones.database)
    return zones, ws.once("model", lambda: w.materialize_marts(
        ws.spark, zones.database, zones.warehouse))


def _ran(ws: Workspace) -> tuple[Zones, DataFrame]:
    def run() -> tuple[Zones, DataFrame]:
        zones = ws.zones(_database())
        _write_sources(ws, zones.source)
        return zones, run_pipeline(ws.spark, zones, ws.as_of, ws.run_ts)

    return ws.once("run", run)


def _database() -> str:
    return f"claims_{dt.datetime.now():%Y%m%d%H%M%S%f}"


# --- scans, sinks, catalog -------------------------------------------------------------------


def discover_csv(ws: Workspace) -> DataFrame:
    root = ws.once("sources", lambda: _write_sources(ws, ws.scratch("source")))
    found = z.discover_tables(ws.spark, root, LANDED_TABLES)
    return _union([
        z.read_csv(ws.spark, *paths).agg(F.count("*").alias("n_rows")).select(
            F.lit(table).alias("table_name"), F.lit(len(paths)).cast("bigint").alias("n_files"), "n_rows")
        for table, paths in found.items() if paths])


def read_raw_csv(ws: Workspace, table: str = "encounters") -> DataFrame:
    root = ws.once("sources", lambda: _write_sources(ws, ws.scratch("source")))
    paths = z.discover_csv(ws.spark, root, table)
    raw = z.read_raw_csv(ws.spark, table, *paths, corrupt_column="_corrupt_record")
    clean = raw.withColumn("corrupt", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")
    return as_double(typed(clean, table, keep=("corrupt",)))


def land_raw(ws: Workspace) -> DataFrame:
    _, snapshots = _landed(ws)
    return mf.landed(ws.spark, snapshots).withColumnsRenamed({"table": "table_name", "rows": "n_rows"})


def landing_stats(ws: Workspace) -> DataFrame:
    return mf.landing_stats(_raw(ws), ws.run_ts, SOURCE_TAG)


def landing_manifest(ws: Workspace) -> DataFrame:
    document = mf.landing_manifest(
        mf.stats_as_landed(landing_stats(ws), ws.as_of), ws.run_ts, SOURCE_TAG, PROJECT)
    return document.select(
        "upload_timestamp", "source", "project", "total_tables", "total_rows", F.inline("tables"),
    ).withColumnsRenamed({"table": "table_name", "rows": "n_rows"})


def missing_tables(ws: Workspace) -> DataFrame:
    """Tables that nothing was landed for; one that landed without rows is not missing."""
    return mf.missing_tables(ws.spark, LANDED_TABLES, landing_stats(ws))


def read_raw_partition(ws: Workspace, table: str = "conditions") -> DataFrame:
    zones, _ = _landed(ws)
    day = z.read_raw_partition(ws.spark, zones.raw, table, ws.as_of)
    return as_double(TRANSFORMS[table](day, ws.as_of, ws.run_ts))


def relanded_day(ws: Workspace) -> DataFrame:
    """What both zones hold for a day that landed in full and then again: smaller for encounters, empty for conditions."""
    def land() -> Zones:
        zones = ws.zones(_database())
        smaller = {"encounters": ws.raw("encounters").where("Id like '%7'"), "conditions": ws.raw("conditions").limit(0)}
        for table, again in smaller.items():
            for raw in (ws.raw(table), again):
                z.land_raw(raw, zones.raw, table, ws.as_of)
                transform_day(ws.spark, zones, ws.as_of, ws.as_of, ws.run_ts)
        return zones

    zones = ws.once("reland", land)
    return _union([
        df.agg(F.count("*").alias("n_rows"), F.count("patient_id").alias("n_patients")).select(
            F.lit(zone).alias("zone"), F.lit(table).alias("table_name"), "n_rows", "n_patients")
        for table in ("encounters", "conditions") for zone, df in (
            ("raw", TRANSFORMS[table](z.read_raw_partition(ws.spark, zones.raw, table, ws.as_of), ws.as_of, ws.run_ts)),
            ("processed", z.read_processed_partition(ws.spark, zones.processed, table, ws.as_of)))])


def write_processed(ws: Workspace) -> DataFrame:
    _, snapshots = _transformed(ws)
    return mf.landed(ws.spark, snapshots).withColumnsRenamed({"table": "table_name", "rows": "n_rows"})


def read_processed_partition(ws: Workspace, table: str = "encounters") -> DataFrame:
    zones, _ = _transformed(ws)
    return as_double(z.read_processed_partition(ws.spark, zones.processed, table, ws.as_of))


def load_warehouse(ws: Workspace) -> DataFrame:
    return _counted(ws, _loaded(ws)[1])


def loaded_table(ws: Workspace, table: str) -> DataFrame:
    return as_double(w.source(ws.spark, _loaded(ws)[0].database, table))


def materialized(ws: Workspace, mart: str) -> DataFrame:
    return as_double(ws.spark.table(f"{_modelled(ws)[0].database}_marts.{mart}"))


def _crawled(ws: Workspace) -> tuple[str, list[str]]:
    def crawl() -> tuple[str, list[str]]:
        zones, _ = _landed(ws)
        database = _database()
        ws.databases.append(database)
        return database, w.crawl_catalog(ws.spark, database, zones.raw, LANDED_TABLES, "csv")

    return ws.once("crawl", crawl)


def crawled_table(ws: Workspace, table: str) -> DataFrame:
    database, _ = _crawled(ws)
    return as_double(TRANSFORMS[table](w.source(ws.spark, database, table).drop("year", "month", "day"), ws.as_of, ws.run_ts))


def crawl_catalog(ws: Workspace) -> DataFrame:
    database, tables = _crawled(ws)
    return _union([
        w.source(ws.spark, database, t).groupBy("year", "month", "day").agg(F.count("*").alias("n_rows"))
        .select(F.lit(t).alias("table_name"), "year", "month", "day", "n_rows") for t in tables])


def register_days(ws: Workspace) -> DataFrame:
    """The landed day, registered without a listing of the zone."""
    def register() -> str:
        zones, _ = _landed(ws)
        database = _database()
        ws.databases.append(database)
        for table in CORE_TABLES:
            w.register_days(ws.spark, database, table, zones.raw, [ws.as_of], "csv")
        return database

    database = ws.once("register", register)
    return _union([
        w.source(ws.spark, database, t).groupBy("year", "month", "day").agg(F.count("*").alias("n_rows"))
        .select(F.lit(t).alias("table_name"), "year", "month", "day", "n_rows") for t in CORE_TABLES])


def source_ref(ws: Workspace) -> DataFrame:
    zones, _ = _loaded(ws)
    models = w.create_staging_views(ws.spark, zones.database)
    sources = {t: w.source(ws.spark, zones.database, t) for t in CORE_TABLES}
    named = sources | {model: w.ref(ws.spark, model) for model in models}
    return _union([
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in named.items()])


def materialize(ws: Workspace) -> DataFrame:
    return _counted(ws, _modelled(ws)[1])


def processed_sizes(ws: Workspace) -> DataFrame:
    zones, _ = _transformed(ws)
    sizes = z.processed_sizes(ws.spark, zones.processed, CORE_TABLES, ws.as_of)
    return sizes.select("table_name", (F.col("bytes") > 0).alias("has_bytes"))


def cached_reads(ws: Workspace) -> DataFrame:
    zones, _ = _modelled(ws)

    def read() -> str:
        w.refresh_marts(ws.spark, zones.database)
        w.cache_marts(ws.spark, zones.database)
        path = ws.scratch("cached-reads")
        c.claims_stats(ws.spark.table(f"{zones.database}_marts.mart_claims_summary")).write.parquet(path)
        w.refresh_marts(ws.spark, zones.database)  # gives the memory back
        return path

    return ws.spark.read.parquet(ws.once("cached reads", read))


def response_document(ws: Workspace) -> DataFrame:
    """The response of the claims listing, opened up again: its total, and each claim with its place."""
    document = envelope(c.claims_summary(ws.claims(), 100), "claims", 100)
    return document.select("total", F.posexplode("claims").alias("place", "claim")).select("total", "place", "claim.*")


def run_summary_record(ws: Workspace) -> DataFrame:
    zones, _ = _ran(ws)
    record = run_summary(ws.spark, zones, ws.as_of)
    return record.select("run_date", (F.col("raw_object_count") > 0).alias("has_raw"), F.explode("quality_results"),
                         "processed_sizes").select(
        "run_date", "has_raw", F.col("key").alias("table_name"), F.col("value").alias("status"),
        (F.try_element_at("processed_sizes", F.col("key")) > 0).alias("has_bytes"))


# --- projections and display ------------------------------------------------------------------


def cost_tiers(ws: Workspace) -> DataFrame:
    return ws.staged("stg_encounters").select(
        "encounter_id", cost_tier(F.col("total_claim_cost")).alias("cost_tier"),
        tier_label(cost_tier(F.col("total_claim_cost"))).alias("tier_label"))


def age_groups(ws: Workspace) -> DataFrame:
    group = age_group(F.col("age_years"))
    return ws.staged("stg_patients").select(
        "patient_id", group.alias("age_group"), age_label(group).alias("age_label"),
        age_label(group, filter_box=True).alias("filter_label"))


def money_text(ws: Workspace) -> DataFrame:
    return v.provider_leaderboard(ws.claims(), 50).select(
        "provider_id", short_id(F.col("provider_id")).alias("short_id"),
        fmt_money(F.col("total_billed")).alias("billed_text"), fmt_money(F.col("avg_cost")).alias("avg_text"))


def known_dimensions(ws: Workspace) -> DataFrame:
    rows = known(ws.claims(), "state", "race", "provider_id", "encounter_class", "age_group", "gender")
    return rows.groupBy("state", "encounter_class").agg(F.count("*").alias("n"))


# --- checks -------------------------------------------------------------------------------------


def dq_report(ws: Workspace) -> DataFrame:
    tables = {model: ws.staged(model) for model in STAGING_MODELS}
    tables |= {"mart_claims_summary": ws.claims(), "mart_patient_metrics": ws.patients()}
    return q.dq_report(tables)


def counted_report(ws: Workspace) -> DataFrame:
    """The declared checks, from what loading and modelling the day have counted."""
    def load() -> tuple[str, dict[str, dict[str, int]]]:
        zones, _ = _transformed(ws)
        database, watched = ws.zones(_database()).database, {}
        w.load_warehouse(ws.spark, zones.processed, database, CORE_TABLES, ws.as_of, zones.warehouse, watched)
        w.create_staging_views(ws.spark, database)
        w.materialize_marts(ws.spark, database, zones.warehouse, watched=watched)
        return database, watched

    database, watched = ws.once("counted", load)
    w.create_staging_views(ws.spark, database)
    return q.dq_report(checked_tables(ws.spark, database), watched)


def validate_raw(ws: Workspace) -> DataFrame:
    return q.validate_raw(ws.spark, {t: ws.raw(t) if t in CORE_TABLES else None for t in LANDED_TABLES})


def raw_partition_present(ws: Workspace) -> DataFrame:
    zones, _ = _landed(ws)
    return _counted(ws, {t: int(z.raw_partition_present(ws.spark, zones.raw, t, ws.as_of) > 0) for t in CORE_TABLES})


def all_raw_partitions_present(ws: Workspace) -> DataFrame:
    zones, _ = _landed(ws, ("patients", "encounters", "conditions"))
    return z.partition_status(ws.spark, zones.raw, CORE_TABLES, ws.as_of)


# --- marts by increments, figures from the rollup ------------------------------------------------


def _lake(ws: Workspace) -> LakeMarts:
    """Marts over three days. One day comes empty at first, another without its conditions; both then land again."""
    def build() -> LakeMarts:
        zones = ws.zones(_database())
        marts = LakeMarts(ws.spark, zones.processed, f"{zones.warehouse}/lake")
        days = [ws.as_of - dt.timedelta(days=ago) for ago in range(3)]
        extracts = {table: ws.raw_written(table) for table in CORE_TABLES}

        def land(ago: int, rows: Callable[[str, DataFrame], DataFrame]) -> None:
            for table in CORE_TABLES:
                z.land_raw(rows(table, _day_of(ws, extracts[table], KEYS[table], ago)), zones.raw, table, days[ago])
            transform_day(ws.spark, zones, days[ago], ws.as_of, ws.run_ts)

        land(0, lambda table, df: df)
        land(1, lambda table, df: df.limit(0))
        land(2, lambda table, df: df.limit(0) if table == "conditions" else df)
        marts.refresh(days)
        for ago in (1, 2):
            land(ago, lambda table, df: df)
            marts.refresh([days[ago]])
        return marts

    return ws.once("lake marts", build)


def overview_from_rollup(ws: Workspace) -> DataFrame:
    return o.overview_kpis(ws.rollup(), ws.claims())


ROLLUP_QUERIES: dict[str, Query] = {
    "claims_stats": lambda ws: c.claims_stats(ws.rollup()),
    "cost_by_state": lambda ws: c.cost_by_state(ws.rollup()),
    "overview_kpis": overview_from_rollup,
    "overview_trend": lambda ws: o.overview_trend(ws.rollup()),
    "cost_tier_counts": lambda ws: o.cost_tier_counts(ws.rollup()),
    "class_counts": lambda ws: o.class_counts(ws.rollup()),
    "age_group_costs": lambda ws: o.age_group_costs(ws.rollup()),
    "state_top12": lambda ws: o.state_top12(ws.rollup()),
    "claims_kpis": lambda ws: c.claims_kpis(ws.rollup()),
    "claims_kpis_filtered": lambda ws: c.claims_kpis(ws.rollup(), **CLAIM_CHOICE),
    "claims_kpis_no_match": lambda ws: c.claims_kpis(ws.rollup(), **NO_CLAIM),
    "claims_state_cost": lambda ws: c.claims_state_cost(ws.rollup()),
    "claims_state_cost_filtered": lambda ws: c.claims_state_cost(ws.rollup(), **CLAIM_CHOICE),
    "class_coverage_split": lambda ws: c.class_coverage_split(ws.rollup()),
    "class_coverage_split_filtered": lambda ws: c.class_coverage_split(ws.rollup(), **CLAIM_CHOICE),
    "claims_trend": lambda ws: c.claims_trend(ws.rollup()),
    "claims_trend_filtered": lambda ws: c.claims_trend(ws.rollup(), **CLAIM_CHOICE),
    "claims_cards": lambda ws: c.claims_cards(ws.rollup()),
}


# --- streams ------------------------------------------------------------------------------------


def _notifications(ws: Workspace) -> DataFrame:
    return object_notifications(ws.spark, ws.sf_dir)


def _alarm(events: DataFrame) -> DataFrame:
    return ingest_error_alarm(events, "ts", F.col("event_type") == "error")


def _defective(ws: Workspace) -> DataFrame:
    return object_notifications(ws.spark, ws.sf_dir, defects=True)


def ingest_event_log_stream(ws: Workspace) -> DataFrame:
    def stream() -> str:
        run = ws.scratch("event-log")
        _notifications(ws).select("value").write.text(f"{run}/in")
        start_event_log(read_notifications(ws.spark, f"{run}/in"), f"{run}/out", f"{run}/checkpoint").awaitTermination()
        return f"{run}/out"

    return ws.spark.read.parquet(ws.once("event log", stream))


def _handled(ws: Workspace) -> str:
    def stream() -> str:
        run = ws.scratch("event-handling")
        _defective(ws).select("value").write.text(f"{run}/in")
        start_event_handling(read_notifications(ws.spark, f"{run}/in"), f"{run}/out", f"{run}/checkpoint").awaitTermination()
        return f"{run}/out"

    return ws.once("event handling", stream)


def ingest_error_alarm_stream(ws: Workspace) -> DataFrame:
    def alarm() -> AlarmSums:
        run = ws.scratch("alarm")
        events = star_table(ws.spark, ws.sf_dir, "events")
        # As a pattern, the path may be one file or a folder of them.
        stream = ws.spark.readStream.schema(events.schema).parquet(f"{ws.sf_dir}/event[s].parquet")
        sums = AlarmSums(ws.spark, f"{run}/out")
        start_error_sums(stream, "ts", F.col("event_type") == "error", sums, f"{run}/checkpoint").awaitTermination()
        return sums

    return ws.once("alarm", alarm).alarms()


# Three days of one extract: all rows under one id fall on one day.
def _day_of(ws: Workspace, raw: DataFrame, key: str, days_ago: int) -> DataFrame:
    return raw.where(F.coalesce(F.ascii(F.right(F.col(key), F.lit(1))) % 3, F.lit(0)) == days_ago)


KEYS = {"patients": "Id", "encounters": "Id", "conditions": "PATIENT", "medications": "PATIENT"}


def three_days(ws: Workspace, table: str) -> DataFrame:
    """Three landed days through the stream, each as of itself."""
    def stream() -> str:
        zones, lake = ws.zones(_database()), ws.scratch("lake")
        for ago in range(3):
            z.land_raw(_day_of(ws, ws.raw(table), KEYS[table], ago), zones.raw, table, ws.as_of - dt.timedelta(days=ago))
        start_incremental_landing(ws.spark, zones.raw, lake, table, ws.scratch("checkpoint"), None, ws.run_ts).awaitTermination()
        return lake

    lake = ws.once(f"three days {table}", stream)
    days = [ws.as_of - dt.timedelta(days=ago) for ago in range(3)]
    return as_double(_union([
        z.read_processed_partition(ws.spark, lake, table, day).withColumn("run_date", F.lit(day)) for day in days]))


def _stream_landing(ws: Workspace, table: str) -> DataFrame:
    def stream() -> str:
        zones, _ = _landed(ws)
        lake, checkpoint = ws.scratch("lake"), ws.scratch("checkpoint")
        start_incremental_landing(ws.spark, zones.raw, lake, table, checkpoint, ws.as_of, ws.run_ts).awaitTermination()
        return f"{lake}/{table}"

    processed = ws.spark.read.parquet(ws.once(f"stream {table}", stream))
    return as_double(processed.drop("year", "month", "day"))


QUERIES: dict[str, Query] = {
    # scans, sinks, catalog
    "discover_csv": discover_csv,
    "read_raw_csv": read_raw_csv,
    "land_raw": land_raw,
    "landing_stats": landing_stats,
    "landing_manifest": landing_manifest,
    "missing_tables": missing_tables,
    "read_raw_partition": read_raw_partition,
    "write_processed": write_processed,
    "read_processed_partition": read_processed_partition,
    "load_warehouse": load_warehouse,
    "crawl_catalog": crawl_catalog,
    "register_days": register_days,
    "source_ref": source_ref,
    "materialize": materialize,
    "processed_sizes": processed_sizes,
    **{f"read_raw_csv_{t}": (lambda ws, t=t: read_raw_csv(ws, t)) for t in ("patients", "conditions", "medications")},
    **{f"read_raw_partition_{t}": (lambda ws, t=t: read_raw_partition(ws, t)) for t in ("patients", "encounters", "medications")},
    **{f"read_processed_partition_{t}": (lambda ws, t=t: read_processed_partition(ws, t)) for t in ("patients", "conditions", "medications")},
    **{f"load_warehouse_{t}": (lambda ws, t=t: loaded_table(ws, t)) for t in CORE_TABLES},
    **{f"crawl_catalog_{t}": (lambda ws, t=t: crawled_table(ws, t)) for t in CORE_TABLES},
    "materialize_claims": lambda ws: materialized(ws, "mart_claims_summary"),
    "materialize_patients": lambda ws: materialized(ws, "mart_patient_metrics"),
    "relanded_day": relanded_day,
    "response_document": response_document,
    "result_envelope": lambda ws: with_total(c.claims_summary(ws.claims(), 1000, encounter_class="emergency")),
    "cached_reads": cached_reads,
    "daily_run": lambda ws: _ran(ws)[1],
    # transforms and staging
    **{f"transform_{t}": (lambda ws, t=t: as_double(ws.transformed(t))) for t in TRANSFORMS},
    **{model: (lambda ws, model=model: as_double(ws.staged(model))) for model in STAGING_MODELS},
    "cost_tier": cost_tiers,
    "age_group": age_groups,
    "eq_filters": lambda ws: as_double(eq_filters(
        ws.claims(), encounter_class="emergency", cost_tier="high", age_group="senior", state=None)),
    "in_filters": lambda ws: as_double(in_filters(
        ws.patients(), state=PATIENT_CHOICE["states"], age_group=["adult", "senior"], gender=[])),
    "get_patient": lambda ws: p.get_patient(ws.patients(), "p42"),
    "known_dimensions": known_dimensions,
    "tier_label": lambda ws: o.tier_chart(ws.claims()),
    "age_label": lambda ws: o.age_chart(ws.claims()),
    "claims_detail_table": lambda ws: c.claims_detail_table(ws.claims()),
    "patient_detail_table": lambda ws: p.patient_detail_table(ws.patients()),
    "provider_detail_table": lambda ws: v.provider_detail_table(ws.claims()),
    "fmt_money": money_text,
    "overview_cards": lambda ws: o.overview_cards(ws.claims()),
    "claims_cards": lambda ws: c.claims_cards(ws.claims()),
    "patient_cards": lambda ws: p.patient_cards(ws.patients()),
    "provider_cards": lambda ws: v.provider_cards(ws.claims()),
    "live_count_cards": lambda ws: o.live_count_cards(ws.claims()),
    # marts
    "mart_claims_summary": lambda ws: as_double(ws.build_claims()),
    "mart_patient_metrics": lambda ws: as_double(ws.build_patients()),
    "encounter_metrics": lambda ws: as_double(m.encounter_metrics(ws.staged("stg_encounters"))),
    "condition_metrics": lambda ws: m.condition_metrics(ws.staged("stg_conditions")),
    "medication_metrics": lambda ws: as_double(m.medication_metrics(ws.staged("stg_medications"))),
    "claims_rollup": lambda ws: as_double(ws.rollup()),
    "incremental_patient_mart": lambda ws: as_double(_lake(ws).patients()),
    "incremental_claims_mart": lambda ws: as_double(_lake(ws).claims()),
    "incremental_rollup": lambda ws: as_double(_lake(ws).rollup()),
    "incremental_overview_trend": lambda ws: o.overview_trend(_lake(ws).rollup()),
    **{f"rollup_{name}": query for name, query in ROLLUP_QUERIES.items()},
    # aggregations
    "claims_stats": lambda ws: c.claims_stats(ws.claims()),
    "cost_by_state": lambda ws: c.cost_by_state(ws.claims()),
    "overview_kpis": lambda ws: o.overview_kpis(ws.claims()),
    "overview_trend": lambda ws: o.overview_trend(ws.claims()),
    "cost_tier_counts": lambda ws: o.cost_tier_counts(ws.claims()),
    "class_counts": lambda ws: o.class_counts(ws.claims()),
    "age_group_costs": lambda ws: o.age_group_costs(ws.claims()),
    "gender_patients": lambda ws: o.gender_patients(ws.patients()),
    "claims_kpis": lambda ws: c.claims_kpis(ws.claims()),
    "claims_kpis_filtered": lambda ws: c.claims_kpis(ws.claims(), **CLAIM_CHOICE),
    "claims_kpis_no_match": lambda ws: c.claims_kpis(ws.claims(), **NO_CLAIM),
    "class_coverage_split": lambda ws: c.class_coverage_split(ws.claims()),
    "class_coverage_split_filtered": lambda ws: c.class_coverage_split(ws.claims(), **CLAIM_CHOICE),
    "claims_trend": lambda ws: c.claims_trend(ws.claims()),
    "claims_trend_filtered": lambda ws: c.claims_trend(ws.claims(), **CLAIM_CHOICE),
    "patient_kpis": lambda ws: p.patient_kpis(ws.patients()),
    "patient_kpis_filtered": lambda ws: p.patient_kpis(ws.patients(), **PATIENT_CHOICE),
    "patient_kpis_no_match": lambda ws: p.patient_kpis(ws.patients(), **NO_PATIENT),
    "patients_by_race": lambda ws: p.patients_by_race(ws.patients()),
    "patients_by_race_filtered": lambda ws: p.patients_by_race(ws.patients(), **PATIENT_CHOICE),
    "age_distribution": lambda ws: p.age_distribution(ws.patients()),
    "age_distribution_filtered": lambda ws: p.age_distribution(ws.patients(), **PATIENT_CHOICE),
    "age_histogram": lambda ws: p.age_histogram(ws.patients()),
    "chronic_distribution": lambda ws: p.chronic_distribution(ws.patients()),
    "chronic_distribution_filtered": lambda ws: p.chronic_distribution(ws.patients(), **PATIENT_CHOICE),
    "provider_kpis": lambda ws: v.provider_kpis(ws.claims()),
    "live_counts": lambda ws: o.live_counts(ws.claims()),
    "distinct_states": lambda ws: p.distinct_states(ws.patients()),
    "dedupe_by_key": lambda ws: one_row_per_key(
        star_table(ws.spark, ws.sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]),
    # sorts and limits
    "provider_leaderboard": lambda ws: v.provider_leaderboard(ws.claims()),
    "provider_leaderboard_by_patients": lambda ws: v.provider_leaderboard(ws.claims(), 50, "Unique Patients"),
    "provider_leaderboard_by_avg_cost": lambda ws: v.provider_leaderboard(ws.claims(), 10, "Avg Claim Cost"),
    "top_providers": lambda ws: v.top_providers(ws.claims()),
    "state_top12": lambda ws: o.state_top12(ws.claims()),
    "claims_state_cost": lambda ws: c.claims_state_cost(ws.claims()),
    "claims_state_cost_filtered": lambda ws: c.claims_state_cost(ws.claims(), **CLAIM_CHOICE),
    "claims_summary": lambda ws: c.claims_summary(ws.claims()),
    "claims_summary_filtered": lambda ws: c.claims_summary(
        ws.claims(), 1000, encounter_class="inpatient", cost_tier="medium", age_group="adult"),
    "claims_detail": lambda ws: c.claims_detail(ws.claims()),
    "claims_detail_filtered": lambda ws: c.claims_detail(ws.claims(), 1000, **CLAIM_CHOICE),
    "patient_metrics": lambda ws: p.patient_metrics(ws.patients()),
    "patient_metrics_filtered": lambda ws: p.patient_metrics(ws.patients(), 500, "adult", "NATION_7"),
    "patient_detail": lambda ws: p.patient_detail(ws.patients()),
    "patient_detail_filtered": lambda ws: p.patient_detail(ws.patients(), 500, **PATIENT_CHOICE),
    "patient_scatter": lambda ws: p.patient_scatter(ws.patients()),
    "patient_scatter_filtered": lambda ws: p.patient_scatter(ws.patients(), **PATIENT_CHOICE),
    # checks
    "validate_raw": validate_raw,
    "dq_unique": lambda ws: q.dq_unique(typed(ws.raw("encounters"), "encounters"), "encounter_id"),
    "dq_not_null": lambda ws: q.dq_not_null(
        ws.staged("stg_encounters"), "encounter_id", "patient_id", "total_claim_cost"),
    "dq_accepted_values": lambda ws: q.dq_accepted_values(ws.staged("stg_patients"), "gender", GENDERS),
    "dq_report": dq_report,
    "dq_report_counted": counted_report,
    "raw_partition_present": raw_partition_present,
    "all_raw_partitions_present": all_raw_partitions_present,
    "run_summary": run_summary_record,
    # streams
    "ingest_event_log": lambda ws: ingest_event_log(_notifications(ws)),
    "ingest_event_log_prefix": lambda ws: ingest_event_log(_notifications(ws), "claims/"),
    "ingest_event_log_stream": ingest_event_log_stream,
    "ingest_event_log_defects": lambda ws: ingest_event_log(_defective(ws)),
    "ingest_event_log_failed": lambda ws: failed_notifications(_defective(ws)),
    "ingest_log_lines": lambda ws: log_lines(ingest_event_log(_notifications(ws)), PROJECT, "dev", ws.run_ts),
    "ingest_failure_alarm": lambda ws: ingest_error_alarm(ingest_errors(_defective(ws), "arrived"), "ts", F.col("failed")),
    "ingest_batch_summary": lambda ws: ingest_batch_summary(_notifications(ws)).select(
        "status_code", "message", "files_processed",
        F.aggregate("files", F.lit(0).cast("bigint"), lambda total, f: total + f["size"]).alias("total_size")),
    "ingest_error_alarm": lambda ws: _alarm(star_table(ws.spark, ws.sf_dir, "events")),
    "ingest_error_alarm_stream": ingest_error_alarm_stream,
    "ingest_event_handling_log": lambda ws: handled_log(ws.spark, _handled(ws)),
    "ingest_event_handling_failed": lambda ws: handled_failures(ws.spark, _handled(ws)),
    **{f"incremental_days_{t}": (lambda ws, t=t: three_days(ws, t)) for t in ("patients", "conditions")},
    **{f"incremental_landing_{t}": (lambda ws, t=t: _stream_landing(ws, t)) for t in CORE_TABLES},
}
