"""Warehouse tables, staging views, mart tables and the catalog."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyward.operators.marts import claims_mart_in_date_order, in_patient_order, patient_mart
from tallyward.operators.quality import watched_counters
from tallyward.operators.staging import STAGING_MODELS, stage
from tallyward.sources.swap import Store
from tallyward.sources.zones import CSV_OPTIONS, day_key, read_processed_partition

MARTS = ("mart_claims_summary", "mart_patient_metrics")
# Folders of a table's versions below its own.
VERSION = "version-"


def _create_database(spark: SparkSession, database: str) -> None:
    spark.sql("CREATE DATABASE IF NOT EXISTS IDENTIFIER(:name)", args={"name": database})


def _quoted(*names: str) -> str:
    return ".".join(f"`{name.replace('`', '``')}`" for name in names)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _layout(spark: SparkSession, name: str) -> tuple[str, str]:
    """What a change of location cannot change: columns, and buckets if there are any."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    buckets = [f"{r.col_name} {r.data_type}" for r in rows if r.col_name in ("Num Buckets", "Bucket Columns", "Sort Columns")]
    return spark.table(name).schema.simpleString(), "; ".join(buckets)


def table_location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    return rows[0].data_type.rstrip("/")


def _write_version(df: DataFrame, database: str, table: str, place: str, buckets: tuple[int, str] | None) -> None:
    """The rows as Parquet below ``place``; bucketed files need a table of their own, whose entry is dropped again."""
    if not buckets:
        df.write.option("compression", "zstd").parquet(place)
        return
    name = _quoted(database, f"{table}__{uuid.uuid4().hex[:8]}")
    try:
        (df.repartition(*buckets).write.format("parquet").option("compression", "zstd").bucketBy(*buckets).sortBy(buckets[1])
            .option("path", place).saveAsTable(name))
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def replace_table(
    df: DataFrame, database: str, table: str, root: str | None = None, buckets: tuple[int, str] | None = None,
    watched: Mapping[str, Column] | None = None, counters: dict[str, int] | None = None,
) -> int:
    """Replace a warehouse table and return its row count, taken while writing; ``watched`` aggregates go to ``counters`` likewise.

    The rows are written to a folder of their own, then the table is pointed there: a write that fails leaves the table as it
    is, and who has begun to read it reads the old rows to the end, as the version before stays until the
    next replacement. If columns or buckets differ, the entry is made anew over the folder that is already complete.
    """
    spark, written = df.sparkSession, Observation()
    name = _quoted(database, table)
    base = f"{(root + '/' + database) if root else spark.catalog.getDatabase(database).locationUri.rstrip('/')}/{table}"
    place = f"{base}/{VERSION}{uuid.uuid4().hex[:12]}"
    store = Store(spark, base)
    try:
        aggregates = [value.alias(counter) for counter, value in (watched or {}).items()]
        _write_version(df.observe(written, F.count(F.lit(1)).alias("rows"), *aggregates), database, table, place, buckets)
    except BaseException:
        store.remove(place)
        raise
    layout = f" CLUSTERED BY ({_quoted(buckets[1])}) SORTED BY ({_quoted(buckets[1])}) INTO {buckets[0]} BUCKETS" if buckets else ""
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
    make = f"CREATE TABLE {{}} ({columns}) USING parquet{layout} LOCATION {_text(place)}"
    before = None
    if spark.catalog.tableExists(name):
        before = table_location(spark, name)
        probe = _quoted(database, f"{table}__{uuid.uuid4().hex[:8]}")
        spark.sql(make.format(probe))
        try:
            same = _layout(spark, probe) == _layout(spark, name)
        finally:
            spark.sql(f"DROP TABLE {probe}")
        if same:
            spark.sql(f"ALTER TABLE {name} SET LOCATION {_text(place)}")
        else:
            spark.sql(f"DROP TABLE {name}")
            spark.sql(make.format(name))
        spark.catalog.refreshTable(name)
    else:
        spark.sql(make.format(name))
    kept = {place.rsplit("/", 1)[1], (before or "").rsplit("/", 1)[-1]}
    for old in store.names(base):
        if old.startswith(VERSION) and old not in kept:
            store.remove(f"{base}/{old}")
    if counters is not None:
        counters |= {counter: written.get[counter] for counter in watched or {}}
    return written.get["rows"]


def load_warehouse(
    spark: SparkSession, processed_root: str, database: str, tables: Iterable[str], run_date: dt.date,
    warehouse_root: str | None = None, watched: dict[str, dict[str, int]] | None = None,
) -> dict[str, int]:
    """Replace the warehouse tables with one processed day each; rows per table.

    With ``watched`` the write also counts what the checks of the staging models ask for, into a dictionary per model.
    """
    _create_database(spark, database)
    counts = {}
    for table in tables:
        day = read_processed_partition(spark, processed_root, table, run_date)
        aggregates = watched_counters(f"stg_{table}", STAGING_MODELS[f"stg_{table}"][1]) if watched is not None else None
        counters: dict[str, int] = {}
        counts[table] = replace_table(day, database, table, warehouse_root, watched=aggregates, counters=counters)
        if watched is not None:
            watched[f"stg_{table}"] = counters
    return counts


def source(spark: SparkSession, database: str, table: str) -> DataFrame:
    return spark.table(f"{database}.{table}")


def ref(spark: SparkSession, model: str) -> DataFrame:
    """A staging view or, by its qualified name, a mart table."""
    return spark.table(model)


def create_staging_views(spark: SparkSession, database: str) -> tuple[str, ...]:
    for model, (table, _, _) in STAGING_MODELS.items():
        stage(model, source(spark, database, table)).createOrReplaceTempView(model)
    return tuple(STAGING_MODELS)


def materialize_marts(
    spark: SparkSession, database: str, warehouse_root: str | None = None, patient_buckets: int | None = None,
    marts: Iterable[str] = MARTS, watched: dict[str, dict[str, int]] | None = None,
) -> dict[str, int]:
    """Build the marts from the staging views into ``<database>_marts``; rows per mart, and ``watched`` as in ``load_warehouse``.

    The claims mart is written in date order, the patient mart in order of its key, in as many files as hold rows.
    With ``patient_buckets``, chosen by the caller for the size of the mart, the patient mart is bucketed on its
    unique key instead, so joins on the patient need no shuffle either.
    """
    place = f"{database}_marts"
    _create_database(spark, place)
    counts = {}
    for name in marts:
        buckets = None
        if name == "mart_claims_summary":
            mart = claims_mart_in_date_order(ref(spark, "stg_encounters"), ref(spark, "stg_patients"))
        else:
            mart = patient_mart(*[ref(spark, f"stg_{t}") for t in ("patients", "encounters", "conditions", "medications")])
            buckets = (patient_buckets, "patient_id") if patient_buckets else None
            mart = mart if buckets else in_patient_order(mart)
        counters: dict[str, int] = {}
        counts[name] = replace_table(mart, place, name, warehouse_root, buckets, watched_counters(name), counters)
        if watched is not None:
            watched[name] = counters
    return counts


def crawl_catalog(
    spark: SparkSession, database: str, root: str, tables: Iterable[str], file_format: str
) -> list[str]:
    """Register the tables of a zone with their partitions; tables that are not there are left out.

    Partitions take the table's columns; a rerun picks up new days and appends columns that the newest day has
    and the table does not.
    """
    _create_database(spark, database)
    options = CSV_OPTIONS if file_format == "csv" else {}
    registered = []
    for table in tables:
        name = f"{database}.{table}"
        if not spark.catalog.tableExists(name):
            try:
                spark.catalog.createTable(name, path=f"{root}/{table}", source=file_format, **options)
            except AnalysisException as error:
                if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                continue
        spark.catalog.recoverPartitions(name)
        _add_new_columns(spark, name, f"{root}/{table}", file_format, options)
        registered.append(table)
    return registered


def register_days(
    spark: SparkSession, database: str, table: str, root: str, days: Iterable[dt.date], file_format: str
) -> list[dt.date]:
    """Register the days of one table that have landed, or gone, since the last time; those that are there.

    Only these days' folders are looked at, where a crawl lists all of them. Columns that the newest of them has
    and the table does not are appended; a day that is not there any more loses its entry.
    """
    _create_database(spark, database)
    name, store, present = f"{database}.{table}", Store(spark, root), []
    options = CSV_OPTIONS if file_format == "csv" else {}
    for day in sorted(set(days)):
        place = f"{root}/{day_key(table, day)}"
        spec = f"year={day.year}, month={day.month}, day={day.day}"
        known = spark.catalog.tableExists(name)
        if not store.exists(place):
            if known:
                spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({spec})")
            continue
        if not known:
            fields = spark.read.options(**options).format(file_format).load(place).schema.fields
            columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in fields)
            listed = ", ".join(f"{_text(k)} = {_text(v)}" for k, v in options.items())
            spark.sql(f"CREATE TABLE {name} ({columns}, year INT, month INT, day INT) USING {file_format} "
                      f"{f'OPTIONS ({listed}) ' if options else ''}PARTITIONED BY (year, month, day) LOCATION {_text(f'{root}/{table}')}")
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION {_text(place)}")
        present.append(day)
    if present:
        _add_columns_of(spark, name, f"{root}/{day_key(table, present[-1])}", file_format, options)
        spark.catalog.refreshTable(name)
    return present


def _add_new_columns(spark: SparkSession, name: str, path: str, file_format: str, options: dict[str, str]) -> None:
    """Columns of the newest partition that a registered table lacks. Folders that are no dates have no say."""
    days = [row.partition for row in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    dated = [day for day in days if all(part.split("=")[1].isdigit() for part in day.split("/"))]
    if dated:
        newest = max(dated, key=lambda day: [int(part.split("=")[1]) for part in day.split("/")])
        _add_columns_of(spark, name, f"{path}/{newest}", file_format, options)


def _add_columns_of(spark: SparkSession, name: str, place: str, file_format: str, options: dict[str, str]) -> None:
    """The columns of one day that the table lacks become its last data columns."""
    known = {column.lower() for column in spark.table(name).columns}
    fields = spark.read.options(**options).format(file_format).load(place).schema.fields
    new = [f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in fields if f.name.lower() not in known]
    if new:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(new)})")


def cache_marts(spark: SparkSession, database: str) -> None:
    """Keep the marts in executor memory for repeated page queries."""
    for mart in MARTS:
        spark.catalog.cacheTable(f"{database}_marts.{mart}")


def refresh_marts(spark: SparkSession, database: str) -> None:
    """Forget cached data and file listings, so the next query reads the tables anew."""
    for mart in MARTS:
        name = f"{database}_marts.{mart}"
        if spark.catalog.isCached(name):
            spark.catalog.uncacheTable(name)
        spark.catalog.refreshTable(name)
