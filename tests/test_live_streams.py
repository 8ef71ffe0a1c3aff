"""Streams whose sinks are replaced by batch id: event handling, error sums, days with their own context."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF, RUN_TS
from frames import ROWS, raw
from tallyward.operators.transforms import TRANSFORMS
from tallyward.plans.pipeline import Zones, run_pipeline
from tallyward.schemas import CORE_TABLES
from tallyward.sources import zones as z
from tallyward.sources.run_days import record_run_day, run_as_of
from tallyward.streaming import alarm as alarm_module
from tallyward.streaming.alarm import AlarmSums, ingest_error_alarm, start_error_sums
from tallyward.streaming.events import (
    failed_notifications, handled_failures, handled_log, handled_notifications, ingest_event_log, read_notifications, start_event_handling,
    write_handled,
)
from tallyward.streaming.landing import start_incremental_landing


def notification(*objects):
    return json.dumps({"Records": [{"s3": {"bucket": {"name": "b"}, "object": o}} for o in objects]})


DOCS = [notification({"key": "claims/a", "size": 1}, {"key": "other/b+c"}), "{}", "broken", notification({"size": 4}),
        notification({"key": "claims/%C3%A9", "size": "many"}), notification(), None, notification({"key": "claims/z"})]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d,) for d in DOCS], "value string")


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_document_is_parsed_once(docs):
    for frame in (ingest_event_log(docs), ingest_event_log(docs, "claims/"), failed_notifications(docs), handled_notifications(docs, "claims/")):
        assert plan(frame).lower().count("jsontostructs") + plan(frame).count("from_json") == 1


def test_one_pass_gives_the_log_and_the_failures(docs):
    rows = handled_notifications(docs)
    assert sorted(map(tuple, rows.where("status = 'logged'").select("bucket", "key", "size", "status").collect())) == sorted(
        map(tuple, ingest_event_log(docs).collect()))
    assert sorted(map(repr, rows.where("status = 'failed'").select("value", "reason", "status").collect())) == sorted(
        map(repr, failed_notifications(docs).collect()))
    below = handled_notifications(docs, "claims/")
    assert sorted(r.key for r in below.where("status = 'logged'").collect()) == ["claims/a", "claims/z"]
    assert below.where("status = 'failed'").count() == 4


def test_event_handling_restarts_and_replays_without_repeating(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def arrive(*texts):
        spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(source)

    def process():
        start_event_handling(read_notifications(spark, source, max_files=1), sink, checkpoint).awaitTermination()
        return sorted(r.key for r in handled_log(spark, sink).collect()), sorted(r.value for r in handled_failures(spark, sink).collect())

    arrive(notification({"key": "k1"}, {"key": "k2"}), "bad 1")
    arrive(notification({"key": "k3"}))
    assert process() == (["k1", "k2", "k3"], ["bad 1"])
    assert process() == (["k1", "k2", "k3"], ["bad 1"])
    arrive("bad 2")
    assert process() == (["k1", "k2", "k3"], ["bad 1", "bad 2"])
    # The last batch is handled again, as after a failure before its commit.
    write_handled(spark.createDataFrame([("bad 2",)], "value string"), 2, sink)
    assert (len(handled_log(spark, sink).collect()), len(handled_failures(spark, sink).collect())) == (3, 2)


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


EVENTS = "ts timestamp, kind string"
BATCHES = [[(at(1), "error"), (at(12), "error"), (at(13), "view")], [(at(3), "error"), (at(30), "view")],
           [(at(2), "error"), (at(60), "view"), (None, "error")], [(at(31), "error")], [(at(61), "error"), (at(2), "view")]]


@pytest.mark.parametrize("merged", [64, 2])
def test_error_sums_equal_the_batch_alarm_at_any_time(spark, tmp_path, monkeypatch, merged):
    monkeypatch.setattr(alarm_module, "MERGED_BATCHES", merged)
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    sums, late = AlarmSums(spark, sink), []
    assert sums.alarms().count() == sums.late_rows(EVENTS).count() == 0
    newest = None
    for number in range(len(BATCHES)):
        spark.createDataFrame(BATCHES[number], EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        start_error_sums(stream, "ts", F.col("kind") == "error", sums, checkpoint).awaitTermination()
        everything = spark.createDataFrame([r for b in BATCHES[:number + 1] for r in b], EVENTS)
        batch_form = ingest_error_alarm(everything, "ts", F.col("kind") == "error")
        assert sorted(sums.alarms().collect()) == sorted(batch_form.collect())  # open periods and late rows are in it
        late += [r for r in BATCHES[number] if newest and r[0] and r[0] < newest - dt.timedelta(minutes=10)]
        newest = max([r[0] for r in BATCHES[number] if r[0]] + ([newest] if newest else []))
        assert sorted(map(tuple, sums.late_rows(EVENTS).collect())) == sorted(late)
    assert sums.periods().agg(F.sum("n_rows"), F.sum("late_rows")).first()[:] == (10, len(late)) and len(late) >= 3
    # The last batch once more, as after a failure before its commit.
    before = sorted(sums.periods().collect())
    sums.add(spark.createDataFrame(BATCHES[-1], EVENTS), len(BATCHES) - 1, "ts", F.col("kind") == "error")
    assert sorted(sums.periods().collect()) == before
    if merged == 2:
        assert len(list((tmp_path / "out" / "sums").iterdir())) < len(BATCHES)


DAYS = [AS_OF - dt.timedelta(days=400), AS_OF - dt.timedelta(days=30), AS_OF]


@pytest.mark.parametrize("table", ["patients", "conditions"])
def test_three_days_equal_three_batch_runs(spark, tmp_path, table):
    zone, lake = str(tmp_path / "raw"), str(tmp_path / "lake")
    df = raw(spark, table, ROWS[table])
    record_run_day(spark, lake, DAYS[1], dt.date(1999, 2, 3))  # its batch run was as of another day

    def process():
        start_incremental_landing(spark, zone, lake, table, str(tmp_path / "checkpoint"), None, RUN_TS).awaitTermination()

    def check(day, as_of):
        got = z.read_processed_partition(spark, lake, table, day)
        expected = TRANSFORMS[table](z.read_raw_partition(spark, zone, table, day), as_of, RUN_TS)
        assert sorted(map(repr, got.select(*expected.columns).collect())) == sorted(map(repr, expected.collect()))

    for day in DAYS:
        z.land_raw(df, zone, table, day)
    process()
    z.land_raw(df.limit(3), zone, table, DAYS[0])  # lands again, years later
    process()
    for day, as_of in zip(DAYS, (DAYS[0], dt.date(1999, 2, 3), DAYS[2])):
        check(day, as_of)
    ages = {"patients": "age_years", "conditions": "days_active"}[table]
    first, last = (z.read_processed_partition(spark, lake, table, d).agg(F.max(ages)).first()[0] for d in (DAYS[0], DAYS[2]))
    assert first < last


def test_the_batch_run_records_its_day(spark, tmp_path):
    zones = Zones(*[str(tmp_path / n) for n in ("source", "raw", "processed", "warehouse")], "claims_context")
    for table in CORE_TABLES:
        raw(spark, table, ROWS[table]).write.options(**z.CSV_OPTIONS).csv(f"{zones.source}/{table}.csv")
    run_pipeline(spark, zones, AS_OF, RUN_TS, as_of=DAYS[0])
    assert run_as_of(spark, zones.processed, AS_OF) == DAYS[0] and run_as_of(spark, zones.processed, DAYS[1]) == DAYS[1]
    start_incremental_landing(spark, zones.raw, zones.processed, "patients", str(tmp_path / "checkpoint"), None, RUN_TS).awaitTermination()
    got = z.read_processed_partition(spark, zones.processed, "patients", AS_OF).agg(F.max("age_years")).first()[0]
    assert got == (DAYS[0] - dt.date(1950, 1, 1)).days // 365
    run_pipeline(spark, zones, AS_OF, RUN_TS)
    assert run_as_of(spark, zones.processed, AS_OF) == AS_OF
    spark.sql("DROP DATABASE claims_context CASCADE")
    spark.sql("DROP DATABASE claims_context_marts CASCADE")
