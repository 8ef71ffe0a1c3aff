"""A daily run that stops and goes on, and days registered one by one."""

import datetime as dt

import pytest

from conftest import AS_OF, RUN_TS
from frames import ROWS, raw
from tallyward.plans import pipeline
from tallyward.plans.pipeline import Zones, run_pipeline
from tallyward.schemas import CORE_TABLES
from tallyward.session import sized_shuffles
from tallyward.sources import warehouse as w
from tallyward.sources import zones as z

STEPS = ("land_raw", "validate_landed", "transform_table", "load_warehouse", "materialize_marts", "dq_report")


@pytest.fixture()
def zones(spark, tmp_path):
    zones = Zones(*[str(tmp_path / n) for n in ("source", "raw", "processed", "warehouse")], "claims_journal")
    for table in CORE_TABLES:
        raw(spark, table, ROWS[table]).write.options(**z.CSV_OPTIONS).csv(f"{zones.source}/{table}.csv")
    yield zones
    for database in ("claims_journal", "claims_journal_marts"):
        spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")


@pytest.fixture()
def calls(monkeypatch):
    """How often each step runs, and which call fails."""
    counted, fails = dict.fromkeys(STEPS, 0), {}

    def watch(name, real):
        def run(*args, **kwargs):
            counted[name] += 1
            if fails.get(name) == counted[name]:
                raise RuntimeError(f"{name} stops")
            return real(*args, **kwargs)

        return run

    for name in STEPS:
        monkeypatch.setattr(pipeline, name, watch(name, getattr(pipeline, name)))
    return counted, fails


@pytest.mark.parametrize(("step", "call", "again"), [
    ("land_raw", 3, {"land_raw": 2, "validate_landed": 1, "transform_table": 4, "load_warehouse": 4, "materialize_marts": 2, "dq_report": 1}),
    ("transform_table", 2, {"land_raw": 0, "validate_landed": 0, "transform_table": 3, "load_warehouse": 4, "materialize_marts": 2, "dq_report": 1}),
    ("load_warehouse", 1, {"land_raw": 0, "validate_landed": 0, "transform_table": 0, "load_warehouse": 4, "materialize_marts": 2, "dq_report": 1}),
    ("materialize_marts", 2, {"land_raw": 0, "validate_landed": 0, "transform_table": 0, "load_warehouse": 0, "materialize_marts": 1, "dq_report": 1}),
])
def test_a_retry_goes_on_behind_the_last_finished_table(spark, zones, calls, step, call, again):
    counted, fails = calls
    fails[step] = call
    with pytest.raises(RuntimeError, match="stops"):
        run_pipeline(spark, zones, AS_OF, RUN_TS)
    fails.clear()
    counted.update(dict.fromkeys(STEPS, 0))
    resumed = run_pipeline(spark, zones, AS_OF, RUN_TS, resume=True).collect()
    assert counted == again
    counted.update(dict.fromkeys(STEPS, 0))
    fresh = run_pipeline(spark, zones, AS_OF, RUN_TS, resume=True).collect()  # the day has ended: run anew
    assert resumed == fresh and counted["land_raw"] == counted["transform_table"] == 4


def test_other_settings_start_anew(spark, zones, calls):
    counted, fails = calls
    fails["load_warehouse"] = 1
    with pytest.raises(RuntimeError):
        run_pipeline(spark, zones, AS_OF, RUN_TS)
    fails.clear()
    counted.update(dict.fromkeys(STEPS, 0))
    run_pipeline(spark, zones, AS_OF, RUN_TS, as_of=AS_OF - dt.timedelta(days=365), resume=True)
    assert counted["land_raw"] == counted["transform_table"] == 4


def test_a_run_leaves_the_session_as_it_was(spark):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    with pytest.raises(RuntimeError), sized_shuffles(spark, 100 * 1024**3):
        assert spark.conf.get(name) == "400"
        raise RuntimeError
    assert spark.conf.get(name, None) == before


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_days_are_registered_as_they_come_and_go(spark, tmp_path, file_format):
    write = {"csv": z.land_raw, "parquet": z.write_processed}[file_format]
    root, database = str(tmp_path), f"days_{file_format}"
    days = [dt.date(2024, 1, n) for n in (5, 6, 7)]

    def frame(*ids, extra=False):
        return spark.createDataFrame([(i, "x") if extra else (i,) for i in ids], "Id string, extra string" if extra else "Id string")

    def rows():
        return sorted((r.Id, r.day) for r in spark.table(f"{database}.t").select("Id", "day").collect())

    assert w.register_days(spark, database, "t", root, days, file_format) == []
    write(frame("a"), root, "t", days[0])
    write(frame("b"), root, "t", days[1])
    assert w.register_days(spark, database, "t", root, [days[0]], file_format) == [days[0]]
    assert rows() == [("a", 5)]  # the other day is there, but nobody has said so
    write(frame("c", extra=True), root, "t", days[2])
    assert w.register_days(spark, database, "t", root, days[1:], file_format) == days[1:]
    assert rows() == [("a", 5), ("b", 6), ("c", 7)]
    assert [r.extra for r in spark.table(f"{database}.t").where("day = 7").collect()] == ["x"]
    write(frame("b", "b2"), root, "t", days[1])  # lands again
    w.register_days(spark, database, "t", root, [days[1]], file_format)
    assert rows() == [("a", 5), ("b", 6), ("b2", 6), ("c", 7)]
    from tallyward.session import remove_folder

    remove_folder(spark, f"{root}/{z.day_key('t', days[0])}")
    assert w.register_days(spark, database, "t", root, [days[0]], file_format) == []
    assert rows() == [("b", 6), ("b2", 6), ("c", 7)]
    (tmp_path / "t" / "year=__HIVE_DEFAULT_PARTITION__" / "month=1" / "day=1").mkdir(parents=True)
    assert w.crawl_catalog(spark, database, root, ["t"], file_format) == ["t"]
    spark.sql(f"DROP DATABASE {database} CASCADE")
