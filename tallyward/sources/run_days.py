"""Which day each processed day was computed as of, kept in the lake beside the tables.

A day may come again, through the batch run or the stream; ages and durations then have to be those of its own run, not those
of whoever happens to process it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from tallyward.sources.swap import Store

FOLDER = "_run_days"


def record_run_day(spark: SparkSession, lake: str, run_date: dt.date, as_of: dt.date) -> None:
    """One small file for each day that was not computed as of itself; the last run of a day counts."""
    path = f"{lake}/{FOLDER}/{run_date.isoformat()}"
    store = Store(spark, lake)
    if as_of != run_date:
        store.write(path, as_of.isoformat())
    elif store.exists(path):
        store.remove(path)


def run_as_of(spark: SparkSession, lake: str, run_date: dt.date) -> dt.date:
    """The day that a day's ages and durations refer to: as recorded, else the day itself."""
    path, store = f"{lake}/{FOLDER}/{run_date.isoformat()}", Store(spark, lake)
    return dt.date.fromisoformat(store.read(path)) if store.exists(path) else run_date
