import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, RUN_TS
from frames import ROWS, raw
from tallyward.operators.transforms import TRANSFORMS
from tallyward.sources import zones as z
from tallyward.streaming.alarm import ingest_error_alarm, start_error_alarm
from tallyward.streaming.events import (
    failed_notifications, ingest_batch_summary, ingest_errors, ingest_event_log, log_lines, read_notifications, start_event_log,
)
from tallyward.streaming.landing import start_incremental_landing


def notification(*objects):
    return json.dumps({"Records": [{"s3": {"bucket": {"name": "b"}, "object": o}} for o in objects]})


def test_keys_are_decoded_and_sizes_default_to_zero(spark):
    docs = spark.createDataFrame([(d,) for d in (
        notification({"key": "claims/a+b%2Fc"}, {"key": "other/%C3%A9", "size": 5}), "{}", '{"Records": []}')], "value string")
    assert sorted(tuple(r) for r in ingest_event_log(docs).collect()) == [
        ("b", "claims/a b/c", 0, "logged"), ("b", "other/é", 5, "logged")]
    assert [r.key for r in ingest_event_log(docs, "claims/").collect()] == ["claims/a b/c"]
    summary = ingest_batch_summary(docs).collect()
    assert sorted(r.files_processed for r in summary) == [0, 0, 2]
    assert {(r.status_code, r.message) for r in summary} == {(200, "Ingestion trigger complete")}
    line = json.loads(log_lines(ingest_event_log(docs), "claims", "dev").first().line)
    assert set(line) == {"event", "project", "environment", "bucket", "key", "size_bytes", "timestamp"}
    assert line["event"] == "s3_object_created" and dt.datetime.fromisoformat(line["timestamp"])


def test_stray_percent_signs_do_not_stop_the_log(spark):
    docs = spark.createDataFrame([(notification({"key": "a%ZZ+b%"}),), (notification({"key": "50%+off%21"}),)], "value string")
    assert sorted(r.key for r in ingest_event_log(docs).collect()) == ["50% off!", "a%ZZ b%"]
    assert sorted(r.files[0].key for r in ingest_batch_summary(docs).collect()) == ["50% off!", "a%ZZ b%"]


def test_event_log_stream_restarts_without_repeating(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def arrive(*keys):
        docs = [(notification({"key": k, "size": 1}),) for k in keys]
        spark.createDataFrame(docs, "value string").coalesce(1).write.mode("append").text(source)

    def process():
        start_event_log(read_notifications(spark, source, max_files=1), sink, checkpoint).awaitTermination()
        return sorted(r.key for r in spark.read.parquet(sink).collect())

    arrive("k1", "k2")
    arrive("k3")
    assert process() == ["k1", "k2", "k3"]
    assert process() == ["k1", "k2", "k3"]
    arrive("k4")
    assert process() == ["k1", "k2", "k3", "k4"]


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def alarm(events):
    return ingest_error_alarm(events, "ts", F.col("kind") == "error")


def test_alarm_counts_errors_per_period(spark):
    events = spark.createDataFrame([(at(1), "error"), (at(4), "error"), (at(5), "view"), (at(11), "error")], "ts timestamp, kind string")
    assert sorted((r.period_start, r.errors) for r in alarm(events).collect()) == [(at(0), 2), (at(10), 1)]
    assert ingest_error_alarm(events, "ts", F.col("kind") == "error", threshold=1).count() == 1


def test_alarm_stream_drops_late_rows_and_reports_closed_periods(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "ts timestamp, kind string"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start_error_alarm(alarm(stream), sink, checkpoint).awaitTermination()
        return sorted((r.period_start, r.errors) for r in spark.read.parquet(sink).collect())

    assert arrive((at(1), "error"), (at(12), "error")) == []
    assert arrive((at(3), "error"), (at(30), "view")) == [(at(0), 2), (at(10), 1)]  # late, but within bounds
    assert arrive((at(2), "error"), (at(60), "view")) == [(at(0), 2), (at(10), 1)]  # behind the watermark: dropped


def test_bad_notifications_are_kept_and_counted(spark):
    good = notification({"key": "a", "size": 1})
    bad = ["no json", notification({"size": 3}), notification({"key": "k", "size": "many"}),
           json.dumps({"Records": [{"s3": {"object": {"key": "k"}}}]}), notification({"key": "x"}, {"size": 1}), None]
    docs = spark.createDataFrame([(d, at(i)) for i, d in enumerate([good, "{}", *bad])], "value string, arrived timestamp")
    assert [r.key for r in ingest_event_log(docs).collect()] == ["a"]
    failed = failed_notifications(docs).collect()
    assert sorted(map(repr, (r.value for r in failed))) == sorted(map(repr, bad)) and {r.status for r in failed} == {"failed"}
    summary = sorted((r.status_code, r.files_processed, len(r.files)) for r in ingest_batch_summary(docs).collect())
    assert summary == [(200, 0, 0), (200, 1, 1)] + [(500, 0, 0)] * len(bad)
    alarms = ingest_error_alarm(ingest_errors(docs, "arrived"), "ts", F.col("failed")).collect()
    assert sorted((r.period_start, r.errors) for r in alarms) == [(at(0), 3), (at(5), 3)]


def landing(spark, tmp_path, table, **options):
    zone, lake, checkpoint = (str(tmp_path / n) for n in ("raw", "lake", "checkpoint"))

    def process():
        start_incremental_landing(spark, zone, lake, table, checkpoint, AS_OF, RUN_TS, **options).awaitTermination()

    def rows(frame):
        return sorted(map(repr, frame.select(*sorted(set(frame.columns) - {"year", "month", "day"})).collect()))

    def held(day):
        return rows(z.read_processed_partition(spark, lake, table, day))

    def batch(day):
        return rows(TRANSFORMS[table](z.read_raw_partition(spark, zone, table, day), AS_OF, RUN_TS))

    return zone, process, held, batch


@pytest.mark.parametrize("table", ["patients", "encounters", "conditions", "medications"])
def test_incremental_landing_equals_the_batch_transform(spark, tmp_path, table):
    zone, process, held, batch = landing(spark, tmp_path, table, max_files=1)
    # The same key in two files of a day: they arrive in different batches.
    df = raw(spark, table, ROWS[table])
    doubled = df.unionByName(df.withColumn("DESCRIPTION" if "DESCRIPTION" in df.columns else "RACE", F.lit("aaa"))).repartition(2)
    z.land_raw(doubled, zone, table, AS_OF)
    process()
    assert held(AS_OF) == batch(AS_OF)
    next_day = AS_OF + dt.timedelta(days=1)
    z.land_raw(df.select(*reversed(df.columns)), zone, table, next_day)  # another order of columns
    process()
    assert held(AS_OF) == batch(AS_OF) and held(next_day) == batch(next_day)


@pytest.mark.parametrize("table", ["patients", "conditions"])
def test_a_day_that_lands_again_replaces_the_old_one(spark, tmp_path, table):
    zone, process, held, batch = landing(spark, tmp_path, table)
    df = raw(spark, table, ROWS[table])
    z.land_raw(df, zone, table, AS_OF)
    process()
    full = held(AS_OF)
    assert full == batch(AS_OF)
    for again in (df.limit(1), df.limit(0)):
        z.land_raw(again, zone, table, AS_OF)
        process()
        assert held(AS_OF) == batch(AS_OF) and len(held(AS_OF)) < len(full)
    assert held(AS_OF) == []
