"""Date-partitioned zones: ``<root>/<table>/year=Y/month=MM/day=DD/``."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyward.schemas import RAW_COLUMNS
from tallyward.sources.swap import COMMITTED, Store, finish_swaps, replace_folders

# Quotes inside a quoted field are doubled, as spreadsheet and pandas exports write them.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}
# Snapshots are compressed, in files of as many rows as one task reads well, because a compressed file is not split.
CSV_WRITE_OPTIONS = {**CSV_OPTIONS, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": "1000000"}
_LISTING = "path STRING, length BIGINT"
_NO_PATTERN = re.compile(r"[\\*?\[\]{}]")


class Snapshot(NamedTuple):
    """What one write put down."""

    table: str
    rows: int
    columns: int
    key: str


def day_key(table: str, run_date: dt.date) -> str:
    return f"{table}/year={run_date.year}/month={run_date.month:02d}/day={run_date.day:02d}"


def _missing_path(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


# Prefixes from which on Spark lists folders by a job of its own, one task each; and how deep they are looked for.
_LISTED_IN_TASKS, _PREFIX_DEPTH = 33, 3


def listing_prefixes(spark: SparkSession, root: str) -> list[str]:
    """Folders and files that together hold all below a root, enough of them that Spark lists them in tasks, one for each.

    The driver lists the upper levels only, until there are enough folders. Hidden names are left out, as Spark does.
    """
    store, folders, files = Store(spark, root), [root], []
    for _ in range(_PREFIX_DEPTH):
        if not 0 < len(folders) < _LISTED_IN_TASKS:
            break
        below = [(f"{folder}/{name}", is_folder) for folder in folders for name, is_folder in store.entries(folder) if name[0] not in "_."]
        folders = [path for path, is_folder in below if is_folder]
        files += [path for path, is_folder in below if not is_folder]
    return folders + files


def objects_under(spark: SparkSession, path: str, names: str = "*", prefixes: list[str] | None = None) -> DataFrame:
    """Path and size of every object below a path whose name fits, without opening any; empty if it is absent."""
    try:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names)
        # Names of listed folders are no patterns.
        files = reader.load([_NO_PATTERN.sub(r"\\\g<0>", p) for p in prefixes] if prefixes else path)
        return files.select("path", "length")
    except AnalysisException as error:
        if not _missing_path(error):
            raise
        return spark.createDataFrame([], _LISTING)


def _any_case(text: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)


def discover_tables(spark: SparkSession, root: str, tables: Iterable[str]) -> dict[str, list[str]]:
    """Every ``<table>.csv`` below a root, in any letter case; a directory of that name counts
    as one file. Folders are listed by tasks, one for each prefix (``listing_prefixes``). Only objects whose own or parent name is a CSV name
    are looked at, and only the matching names come back."""
    tables = list(tables)
    pattern = rf"(?i)^(.*/({'|'.join(map(re.escape, tables))})\.csv)(?:/.*)?$"
    hits = objects_under(spark, root, f"*{_any_case('.csv')}*", listing_prefixes(spark, root)).select(
        F.regexp_extract("path", pattern, 1).alias("hit"), F.lower(F.regexp_extract("path", pattern, 2)).alias("stem"))
    found = hits.where(F.col("hit") != "").distinct().collect()
    return {table: sorted(row.hit for row in found if row.stem == table.lower()) for table in tables}


def discover_csv(spark: SparkSession, root: str, table: str) -> list[str]:
    return discover_tables(spark, root, [table])[table]


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Header CSV with every column as text: one look at the header, no inference pass.

    All files must carry the same header, else Spark raises instead of shifting columns.
    """
    return spark.read.options(**CSV_OPTIONS, enforceSchema="false").csv(list(paths))


def read_raw_csv(spark: SparkSession, table: str, *paths: str, corrupt_column: str | None = None) -> DataFrame:
    """The known columns of a raw table by header name, typed.

    A field that does not parse is NULL; with ``corrupt_column`` the whole source row is then
    kept there as JSON.
    """
    text = read_csv(spark, *paths)
    columns = RAW_COLUMNS[table]
    parsed = {name: F.col(name).try_cast(kind) for name, (_, kind) in columns.items()}
    selected = [value.alias(name) for name, value in parsed.items()]
    if corrupt_column:
        broken = F.lit(False)
        for name, value in parsed.items():
            broken = broken | (F.col(name).isNotNull() & value.isNull())
        selected.append(F.when(broken, F.to_json(F.struct(*columns))).alias(corrupt_column))
    return text.select(*selected)


def _write_day(df: DataFrame, root: str, table: str, run_date: dt.date, source: str, **options: str) -> Snapshot:
    """Replace one day's partition, also by no rows, and leave other days alone. Rows are counted by the write.

    The day is written beside and moved into place when it is complete: a write that fails leaves the old day.
    """
    written = Observation()
    key = day_key(table, run_date)
    counted = df.observe(written, F.count(F.lit(1)).alias("rows")).write.format(source).options(**options)
    replace_folders(df.sparkSession, root, [key], lambda staged: counted.save(f"{staged}/{key}"))
    return Snapshot(table, written.get["rows"], len(df.columns), key)


def write_days(days: list[tuple[dt.date, DataFrame]], root: str, table: str) -> None:
    """Replace the processed days of several frames by one job; a day without rows is not touched."""
    dated = [df.withColumns({"year": F.lit(str(day.year)), "month": F.lit(f"{day.month:02d}"), "day": F.lit(f"{day.day:02d}")})
             for day, df in days]
    rows = reduce(DataFrame.unionByName, dated).write.partitionBy("year", "month", "day").option("compression", "snappy")

    def write(staged: str) -> None:
        rows.parquet(f"{staged}/{table}")
        Store(dated[0].sparkSession, staged).write(f"{staged}/{COMMITTED}", "")

    replace_folders(dated[0].sparkSession, root, [day_key(table, day) for day, _ in days], write)


def _read_day(spark: SparkSession, root: str, path: str, read: Callable[[str], DataFrame], missing: str) -> DataFrame:
    """A day by its path. If it is absent, a replacement that was cut short may have it: finish that and look again."""
    for finished in (False, True):
        try:
            day = read(path)
            if day.columns:
                return day
        except AnalysisException as error:
            if not _missing_path(error):
                raise
        if finished or not finish_swaps(spark, root):
            break
    raise FileNotFoundError(f"{missing} at {path}")


def land_raw(df: DataFrame, root: str, table: str, run_date: dt.date) -> Snapshot:
    """Snapshot of a source table as compressed CSV in the raw zone."""
    return _write_day(df, root, table, run_date, "csv", **CSV_WRITE_OPTIONS)


def read_raw_partition(spark: SparkSession, root: str, table: str, run_date: dt.date) -> DataFrame:
    """One landed day, addressed by its path so that no other day is listed."""
    return _read_day(spark, root, f"{root}/{day_key(table, run_date)}", lambda path: read_csv(spark, path), "no raw data")


def write_processed(
    df: DataFrame, root: str, table: str, run_date: dt.date, max_records_per_file: int | None = None
) -> Snapshot:
    """Snapshot of a processed table as Snappy Parquet, written by as many tasks as hold rows."""
    options = {"compression": "snappy"}
    if max_records_per_file:
        options["maxRecordsPerFile"] = str(max_records_per_file)
    return _write_day(df, root, table, run_date, "parquet", **options)


def read_processed_partition(spark: SparkSession, root: str, table: str, run_date: dt.date) -> DataFrame:
    return _read_day(spark, root, f"{root}/{day_key(table, run_date)}", spark.read.parquet, "no processed data")


def day_objects(spark: SparkSession, root: str, tables: tuple[str, ...], run_date: dt.date) -> DataFrame:
    """Object count and bytes per table for one day; a table without objects has zeros."""
    listings = None
    for table in tables:
        found = objects_under(spark, f"{root}/{day_key(table, run_date)}").agg(
            F.count("*").alias("objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        row = found.select(F.lit(table).alias("table_name"), "objects", "bytes")
        listings = row if listings is None else listings.unionByName(row)
    return listings


def processed_sizes(spark: SparkSession, root: str, tables: tuple[str, ...], run_date: dt.date) -> DataFrame:
    return day_objects(spark, root, tables, run_date).select("table_name", "bytes")


def raw_partition_present(spark: SparkSession, root: str, table: str, run_date: dt.date) -> int:
    """Number of objects landed for a day; raises when there are none."""
    count = objects_under(spark, f"{root}/{day_key(table, run_date)}").count()
    if not count:
        raise ValueError(f"no raw data at {day_key(table, run_date)}: land it first")
    return count


def partition_status(spark: SparkSession, root: str, tables: tuple[str, ...], run_date: dt.date) -> DataFrame:
    """PASS for every table that has objects for the day, FAIL for the others."""
    found = day_objects(spark, root, tables, run_date)
    return found.select("table_name", F.when(F.col("objects") > 0, "PASS").otherwise("FAIL").alias("status"))


def all_raw_partitions_present(
    spark: SparkSession, root: str, tables: tuple[str, ...], run_date: dt.date
) -> dict[str, str]:
    """The status per table as a dictionary; raises and names the tables that are not there."""
    status = {r.table_name: r.status for r in partition_status(spark, root, tables, run_date).collect()}
    failed = [table for table in tables if status[table] == "FAIL"]
    if failed:
        raise ValueError(f"no raw data for {', '.join(failed)}")
    return status
