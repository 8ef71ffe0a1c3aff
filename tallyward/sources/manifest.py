"""What a landing run put down: per-table statistics and the manifest document."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.sources.zones import Snapshot, day_key


def landing_stats(tables: dict[str, DataFrame], uploaded_at: dt.datetime, source: str) -> DataFrame:
    """Row and column count, time and source tag per table."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(table).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).cast("bigint").alias("col_count"),
            F.lit(uploaded_at).alias("upload_ts"),
            F.lit(source).alias("source"),
        )
        for table, df in tables.items()
    ])


def landed(spark: SparkSession, snapshots: Iterable[Snapshot]) -> DataFrame:
    """The snapshots of one run as rows; a handful of tables, already counted by their writes."""
    rows = [(s.table, s.rows, s.key) for s in snapshots]
    return spark.createDataFrame(rows, "`table` STRING, `rows` BIGINT, `key` STRING")


def stats_as_landed(stats: DataFrame, run_date: dt.date) -> DataFrame:
    """Landing statistics in the shape the manifest lists them."""
    suffix = day_key("", run_date)
    return stats.select(
        F.col("table_name").alias("table"), F.col("row_count").alias("rows"),
        F.concat("table_name", F.lit(suffix)).alias("key"))


def landing_manifest(tables: DataFrame, uploaded_at: dt.datetime, source: str, project: str) -> DataFrame:
    """One document: the landed tables (one entry each) and their totals."""
    entries = F.sort_array(F.collect_list(F.struct("table", "rows", "key")))
    return tables.agg(
        F.lit(uploaded_at).alias("upload_timestamp"),
        F.lit(source).alias("source"),
        F.lit(project).alias("project"),
        entries.alias("tables"),
        F.count("*").alias("total_tables"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
    )


def write_manifest(manifest: DataFrame, root: str, uploaded_at: dt.datetime) -> str:
    """Store the document under a time-stamped name and return its key."""
    key = f"_manifests/{uploaded_at:%Y%m%d_%H%M%S}_manifest.json"
    manifest.write.mode("overwrite").json(f"{root}/{key}")
    return key


def missing_tables(spark: SparkSession, expected: Iterable[str], found: DataFrame) -> DataFrame:
    """Expected names that nothing was landed for."""
    names = spark.createDataFrame([(name,) for name in expected], "table_name STRING")
    return names.join(found.select("table_name"), "table_name", "left_anti")
