"""Object-created notifications: the ingestion log and the per-notification summary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyward.schemas import OBJECT_CREATED_EVENT

# Texts of the log line and the summary.
LOGGED_EVENT = "s3_object_created"
SUMMARY_MESSAGE = "Ingestion trigger complete"

FAILED_MESSAGE = "Ingestion trigger failed"


def read_notifications(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of notification documents, one JSON text per line."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def _parsed(notifications: DataFrame) -> DataFrame:
    """The notifications with their records and, if the document or one of its records cannot be used, the reason.

    A usable record names its bucket and key, and its size, if it has one, is a whole number. The document is taken out of a generator:
    no filter or projection moves below that, so it is parsed once however often it is looked into.
    """
    document = F.from_json("value", f"{OBJECT_CREATED_EVENT}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    parsed = notifications.select("*", F.explode(F.array(document)).alias("document"))
    records = F.coalesce("document.Records", F.array())
    bad = F.exists(records, lambda r: r["s3"]["bucket"]["name"].isNull() | r["s3"]["object"]["key"].isNull() | (
        r["s3"]["object"]["size"].isNotNull() & r["s3"]["object"]["size"].try_cast("bigint").isNull()))
    reason = F.when(F.col("document").isNull() | F.col("document._broken").isNotNull(), "not a JSON document").when(bad, "unusable record")
    return parsed.withColumns({"records": records, "reason": reason}).drop("document")


def _decoded(key: Column) -> Column:
    """URL-decoded key; a percent sign that starts no escape stands for itself."""
    return F.url_decode(F.regexp_replace(key, "%(?![0-9A-Fa-f]{2})", "%25"))


def _size(record: Column) -> Column:
    return F.coalesce(record["s3"]["object"]["size"].try_cast("bigint"), F.lit(0))


def ingest_event_log(notifications: DataFrame, prefix: str | None = None) -> DataFrame:
    """One row per created object: decoded key, size (0 when absent), status.

    With a prefix only keys below it are logged. Notifications that fail are in ``failed_notifications``, whole.
    """
    objects = _parsed(notifications).where("reason is null").select(F.explode("records").alias("record"))
    log = objects.select(
        F.col("record.s3.bucket.name").alias("bucket"),
        _decoded(F.col("record.s3.object.key")).alias("key"),
        _size(F.col("record")).alias("size"),
        F.lit("logged").alias("status"),
    )
    return log.where(F.col("key").startswith(prefix)) if prefix else log


def failed_notifications(notifications: DataFrame) -> DataFrame:
    """One row per notification that cannot be handled: its text, the reason, status ``failed``."""
    return _parsed(notifications).where("reason is not null").select("value", "reason", F.lit("failed").alias("status"))


def ingest_errors(notifications: DataFrame, time: str) -> DataFrame:
    """(ts, failed) of each notification, as the error alarm takes them; ``time`` is when it arrived."""
    return _parsed(notifications).select(F.col(time).alias("ts"), F.col("reason").isNotNull().alias("failed"))


def log_lines(log: DataFrame, project: str, environment: str, run_ts: dt.datetime | None = None) -> DataFrame:
    """The log rows as JSON text, stamped with ``run_ts``, by default the time they are processed."""
    stamp = F.current_timestamp() if run_ts is None else F.lit(run_ts)
    line = F.struct(
        F.lit(LOGGED_EVENT).alias("event"),
        F.lit(project).alias("project"),
        F.lit(environment).alias("environment"),
        "bucket",
        "key",
        F.col("size").alias("size_bytes"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )
    return log.select(F.to_json(line).alias("line"))


def ingest_batch_summary(notifications: DataFrame) -> DataFrame:
    """One row per notification: how many objects it named and which; a failed one has status 500 and none."""
    files = F.transform("records", lambda r: F.struct(
        r["s3"]["bucket"]["name"].alias("bucket"),
        _decoded(r["s3"]["object"]["key"]).alias("key"),
        _size(r).alias("size"),
        F.lit("logged").alias("status"),
    ))
    failed = F.col("reason").isNotNull()
    handled = F.when(failed, F.slice(files, 1, 0)).otherwise(files)
    return _parsed(notifications).select(
        F.when(failed, 500).otherwise(200).alias("status_code"),
        F.when(failed, FAILED_MESSAGE).otherwise(SUMMARY_MESSAGE).alias("message"),
        F.size(handled).cast("bigint").alias("files_processed"),
        handled.alias("files"),
    )


def start_event_log(
    notifications: DataFrame, sink: str, checkpoint: str, prefix: str | None = None
) -> StreamingQuery:
    """Log everything that has arrived to Parquet and stop; a restart adds only what is new."""
    return (
        ingest_event_log(notifications, prefix).writeStream.format("parquet")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


_HANDLED = "bucket STRING, key STRING, size BIGINT, status STRING, value STRING, reason STRING"


def handled_notifications(notifications: DataFrame, prefix: str | None = None) -> DataFrame:
    """The rows of ``ingest_event_log`` (status ``logged``) and of ``failed_notifications`` from one parse."""
    entry = "STRUCT<bucket: STRING, key: STRING, size: BIGINT, status: STRING, value: STRING, reason: STRING>"
    nothing = F.lit(None).cast("string")
    logged = F.transform("records", lambda r: F.struct(
        r["s3"]["bucket"]["name"], _decoded(r["s3"]["object"]["key"]), _size(r), F.lit("logged"), nothing, nothing).cast(entry))
    failed = F.array(F.struct(nothing, nothing, F.lit(None).cast("bigint"), F.lit("failed"), F.col("value"), F.col("reason")).cast(entry))
    rows = _parsed(notifications).select(F.inline(F.when(F.col("reason").isNull(), logged).otherwise(failed)))
    return rows.where((F.col("status") == "failed") | F.col("key").startswith(prefix)) if prefix else rows


def write_handled(batch: DataFrame, batch_id: int, sink: str, prefix: str | None = None) -> None:
    """Both outcomes of one batch below ``<sink>/batch=<id>``, in one job; a replayed batch replaces what it wrote."""
    rows = handled_notifications(batch, prefix).withColumn("outcome", F.col("status"))
    rows.write.mode("overwrite").partitionBy("outcome").parquet(f"{sink}/batch={batch_id}")


def start_event_handling(notifications: DataFrame, sink: str, checkpoint: str, prefix: str | None = None) -> StreamingQuery:
    """Log everything that has arrived, and keep what failed, from one pass over it; a restart adds only what is new."""
    return (
        notifications.writeStream.foreachBatch(lambda batch, batch_id: write_handled(batch, batch_id, sink, prefix))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _handled(spark: SparkSession, sink: str, outcome: str) -> DataFrame:
    return spark.read.schema(f"{_HANDLED}, batch BIGINT, outcome STRING").parquet(sink).where(F.col("outcome") == outcome)


def handled_log(spark: SparkSession, sink: str) -> DataFrame:
    """What ``start_event_handling`` has logged, as ``ingest_event_log`` gives it. Only its folders are read."""
    return _handled(spark, sink, "logged").select("bucket", "key", "size", "status")


def handled_failures(spark: SparkSession, sink: str) -> DataFrame:
    return _handled(spark, sink, "failed").select("value", "reason", "status")
