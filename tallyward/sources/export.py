"""Results leaving the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.operators.filters import check_limit


MOST_ROWS = 1000


def envelope(listing: DataFrame, field: str, limit: int) -> DataFrame:
    """One row: the number of rows of a listing of at most ``limit`` rows and the rows themselves, in order.

    The whole document is one row, so the limit is checked here and holds whatever the listing is.
    """
    check_limit(limit, 1, MOST_ROWS)
    return listing.limit(limit).agg(F.count("*").alias("total"), F.collect_list(F.struct("*")).alias(field))


def with_total(listing: DataFrame) -> DataFrame:
    """The rows of a limited listing, each with the number of rows returned."""
    return listing.withColumn("total", F.count("*").over(Window.partitionBy()))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, written by the executors."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
