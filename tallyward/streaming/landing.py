"""The raw zone as a stream: days that change flow into the processed layer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyward.operators.transforms import TRANSFORMS
from tallyward.sources.run_days import run_as_of
from tallyward.sources.zones import read_raw_partition, write_days, write_processed

_FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
# Days that one job transforms together.
DAYS_AT_ONCE = 32


def read_changed_days(spark: SparkSession, root: str, table: str, max_files: int | None = None) -> DataFrame:
    """Stream of the days of one landed table that new files belong to. The files are not opened."""
    reader = (spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true")
              .option("ignoreMissingFiles", "true").option("pathGlobFilter", "*.csv*"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    part = lambda name: F.regexp_extract("path", rf"/{name}=(\d+)/", 1).cast("int").alias(name)
    return reader.load(f"{root}/{table}").select(part("year"), part("month"), part("day"))


def replace_days(spark: SparkSession, root: str, lake: str, table: str, days: list[dt.date], as_of: dt.date | None, run_ts: dt.datetime) -> None:
    """Transform the current raw partition of each day and replace its processed day, all days in one job.

    Without ``as_of`` each day is computed as of the day that its batch run had, else as of itself. Every day is read by its own
    header, so the order of its columns does not matter. A day without rows is replaced by an empty one; a day that is gone
    from the raw zone is left alone.
    """
    frames, counts = [], {}
    for day in days:
        try:
            raw = read_raw_partition(spark, root, table, day)
        except FileNotFoundError:
            continue
        counts[day] = Observation()
        frames.append((day, TRANSFORMS[table](raw, as_of or run_as_of(spark, lake, day), run_ts).observe(counts[day], F.count(F.lit(1)).alias("rows"))))
    if frames:
        write_days(frames, lake, table)
        for day, frame in frames:
            if not counts[day].get["rows"]:
                write_processed(spark.createDataFrame([], frame.schema), lake, table, day)


def start_incremental_landing(
    spark: SparkSession, root: str, lake: str, table: str, checkpoint: str, as_of: dt.date | None, run_ts: dt.datetime,
    max_files: int | None = None,
) -> StreamingQuery:
    """Bring every day that has changed since the last run up to date in the processed layer and stop.

    The stream only says which days have new files. Those days are transformed from all that the raw zone
    holds for them now, so the outcome equals the batch run, however many batches bring a day, when a day
    lands again, smaller or empty, and when a batch is replayed. ``as_of`` None gives every day its own context
    (``replace_days``), as a batch run of that day would.
    """

    def bring_up_to_date(batch: DataFrame, batch_id: int) -> None:
        # One row per changed day; only dates reach the driver.
        changed = sorted(dt.date(*row) for row in batch.where("year is not null").distinct().collect())
        for at in range(0, len(changed), DAYS_AT_ONCE):
            replace_days(spark, root, lake, table, changed[at:at + DAYS_AT_ONCE], as_of, run_ts)

    return (
        read_changed_days(spark, root, table, max_files).writeStream.foreachBatch(bring_up_to_date)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
