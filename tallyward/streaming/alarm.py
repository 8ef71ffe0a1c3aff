"""Error alarm: too many errors within one period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyward.sources.swap import COMMITTED, Store

# Five-minute sums, alarm above zero.
PERIOD = "300 seconds"
THRESHOLD = 0
LATENESS = "10 minutes"
# Batches whose sums are merged into one.
MERGED_BATCHES = 64
_SUMS = "period_start TIMESTAMP, period_end TIMESTAMP, errors BIGINT, n_rows BIGINT, late_rows BIGINT, newest TIMESTAMP"


def ingest_error_alarm(
    events: DataFrame, time: str, is_error: Column, period: str = PERIOD, threshold: int = THRESHOLD,
    lateness: str = LATENESS,
) -> DataFrame:
    """Periods whose error sum exceeds the threshold.

    On a stream, a period is reported once the watermark has passed its end and rows later
    than that are dropped. Errors are summed per task before the shuffle.
    """
    timed = events.select(F.col(time).cast("timestamp").alias("ts"), is_error.cast("bigint").alias("error"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    sums = timed.groupBy(F.window("ts", period).alias("period")).agg(F.sum("error").alias("errors"))
    return sums.where(F.col("errors") > threshold).select(
        F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), "errors")


def start_error_alarm(alarm: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    return (
        alarm.writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


class AlarmSums:
    """Error sums of a stream per period, kept as one small table of sums for each batch below ``sink``.

    Sums add up whatever the order of their batches, so open periods are there from their first row on, and rows of any age
    correct the period they belong to. A replayed batch replaces its own sums. Every ``MERGED_BATCHES`` batches the sums so
    far become one table; what it replaces goes at the next merge, when nobody reads it any more.
    """

    def __init__(self, spark: SparkSession, sink: str, period: str = PERIOD, lateness: str = LATENESS):
        self.spark, self.sink, self.period, self.lateness = spark, sink.rstrip("/"), period, lateness

    def _merged_to(self, before: int | None = None) -> int:
        """The last batch of the newest complete merge (of batches before ``before``), -1 without one."""
        store, folder = Store(self.spark, self.sink), f"{self.sink}/merged"
        ends = [int(name.split("=")[1]) for name in store.names(folder) if store.exists(f"{folder}/{name}/{COMMITTED}")]
        return max((end for end in ends if before is None or end < before), default=-1)

    def _parts(self, before: int | None = None) -> DataFrame:
        """Sums of all batches (before ``before``), several rows for a period."""
        end = self._merged_to(before)
        found = [f"{self.sink}/sums/{name}" for name in Store(self.spark, self.sink).names(f"{self.sink}/sums")
                 if end < int(name.split("=")[1]) and (before is None or int(name.split("=")[1]) < before)]
        found += [f"{self.sink}/merged/upto={end}"] if end >= 0 else []
        return self.spark.read.schema(_SUMS).parquet(*found) if found else self.spark.createDataFrame([], _SUMS)

    @staticmethod
    def _added(parts: DataFrame) -> DataFrame:
        return parts.groupBy("period_start", "period_end").agg(
            *[F.sum(c).alias(c) for c in ("errors", "n_rows", "late_rows")], F.max("newest").alias("newest"))

    def add(self, batch: DataFrame, batch_id: int, time: str, is_error: Column) -> None:
        """Adds a batch. Late are rows older, by more than the lateness, than the newest row of the batches before it; they
        count like all others, and are kept whole in ``late_rows``."""
        newest = self._parts(batch_id).agg(F.max("newest")).first()[0]
        ts = F.col(time).cast("timestamp")
        late = F.lit(False) if newest is None else ts < F.lit(newest) - F.expr(f"INTERVAL {self.lateness}")
        timed = batch.select(ts.alias("ts"), is_error.cast("bigint").alias("error"), late.alias("late"))
        sums = timed.groupBy(F.window("ts", self.period).alias("period")).agg(
            F.sum("error").alias("errors"), F.count("*").alias("n_rows"), F.count_if("late").alias("late_rows"), F.max("ts").alias("newest"))
        place = f"{self.sink}/sums/batch={batch_id}"
        sums.select("period.start", "period.end", "errors", "n_rows", "late_rows", "newest").toDF(
            "period_start", "period_end", "errors", "n_rows", "late_rows", "newest").coalesce(1).write.mode("overwrite").parquet(place)
        if self.spark.read.schema(_SUMS).parquet(place).where("late_rows > 0").limit(1).count():
            batch.where(late).write.mode("overwrite").parquet(f"{self.sink}/late/batch={batch_id}")
        if (batch_id + 1) % MERGED_BATCHES == 0:
            self._merge(batch_id)

    def _merge(self, batch_id: int) -> None:
        store, before = Store(self.spark, self.sink), self._merged_to(batch_id)
        self._added(self._parts()).coalesce(1).write.mode("overwrite").parquet(f"{self.sink}/merged/upto={batch_id}")
        for folder, gone in (("sums", lambda end: end <= before), ("merged", lambda end: end < before)):
            for name in store.names(f"{self.sink}/{folder}"):
                if gone(int(name.split("=")[1])):
                    store.remove(f"{self.sink}/{folder}/{name}")

    def periods(self) -> DataFrame:
        """period_start, period_end, errors, n_rows, late_rows, newest: every period up to the last batch, open ones too."""
        return self._added(self._parts())

    def alarms(self, threshold: int = THRESHOLD) -> DataFrame:
        """Periods whose error sum exceeds the threshold, as the batch form gives them for all rows so far."""
        return self.periods().where(F.col("errors") > threshold).select("period_start", "period_end", "errors")

    def late_rows(self, schema: str) -> DataFrame:
        """The late rows as they came; ``schema`` is that of the stream."""
        if not Store(self.spark, self.sink).exists(f"{self.sink}/late"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, batch BIGINT").parquet(f"{self.sink}/late").drop("batch")


def start_error_sums(events: DataFrame, time: str, is_error: Column, sums: AlarmSums, checkpoint: str) -> StreamingQuery:
    """Add everything that has arrived to the sums and stop. ``sums.alarms()`` then is the alarm for all of it."""
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: sums.add(batch, batch_id, time, is_error))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
