"""The plans Spark picks: what reaches the scan, what is shuffled, what happens to a hot key."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tallyward.operators.dedupe import one_row_per_key
from tallyward.operators.marts import claims_mart, claims_mart_in_date_order, in_date_order, in_patient_order, patient_mart
from tallyward.plans.catalogue import QUERIES
from tallyward.sources.star_schema import star_table

WRITES = {"discover_csv", "read_raw_csv", "land_raw", "read_raw_partition", "write_processed",
          "read_processed_partition", "load_warehouse", "crawl_catalog", "source_ref", "materialize",
          "processed_sizes", "cached_reads", "daily_run", "raw_partition_present", "all_raw_partitions_present",
          "run_summary", "ingest_event_log_stream", "ingest_error_alarm_stream",
          "relanded_day", "response_document"}
PREFIXES = ("read_raw_partition_", "read_processed_partition_", "load_warehouse_", "crawl_catalog_", "materialize_", "incremental_landing_")


def plan(df, mode="formatted"):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode=mode)
    return text.getvalue()


@contextlib.contextmanager
def settings(spark, **values):
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITES and not n.startswith(PREFIXES)])
def test_no_python_workers_and_no_pairwise_joins(ws, name):
    text = plan(QUERIES[name](ws))
    for word in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def read_columns(text):
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<(.*?)>\n", text)]


@pytest.mark.parametrize("name, columns", [
    ("cost_tier_counts", {"cost_tier"}),
    ("state_top12", {"state", "total_claim_cost"}),
    ("gender_patients", {"gender", "patient_id"}),
    ("chronic_distribution", {"chronic_conditions"}),
])
def test_scans_read_only_the_columns_used(ws, name, columns):
    assert read_columns(plan(QUERIES[name](ws))) == [columns]


@pytest.mark.parametrize("name, filters", [
    ("eq_filters", ["EqualTo(encounter_class,emergency)", "EqualTo(cost_tier,high)", "EqualTo(age_group,senior)"]),
    ("claims_kpis_filtered", ["In(encounter_class, [emergency,inpatient])"]),
    ("get_patient", ["EqualTo(patient_id,p42)"]),
    ("patient_kpis_filtered", ["In(state, [NATION_11,NATION_3,NATION_7])", "EqualTo(gender,F)"]),
    ("cost_by_state", ["IsNotNull(state)"]),
])
def test_filters_reach_the_scan(ws, name, filters):
    (pushed,) = re.findall(r"PushedFilters: \[(.*)\]\n", plan(QUERIES[name](ws)))
    assert all(f in pushed for f in filters), pushed


@pytest.mark.parametrize("name", ["claims_summary", "claims_detail", "patient_metrics", "patient_scatter", "state_top12",
                                  "claims_state_cost", "patients_by_race", "top_providers", "provider_leaderboard"])
def test_limits_are_top_k_without_a_full_sort(ws, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](ws))


@pytest.mark.parametrize("name", ["claims_summary", "claims_summary_filtered", "claims_detail_filtered"])
def test_newest_first_pushes_its_cutoff_into_the_scan(ws, name):
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(encounter_date,ScalarSubquery", plan(QUERIES[name](ws)))


def test_patient_mart_exchanges_each_input_once(spark, ws):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
        text = plan(patient_mart(*[ws.staged(f"stg_{t}") for t in ("patients", "encounters", "conditions", "medications")]))
    assert len(re.findall(r"Arguments: hashpartitioning\(patient_id", text)) == 4


def test_duplicates_combine_before_the_shuffle(spark, sf_dir):
    text = plan(one_row_per_key(star_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]), "simple")
    assert text.index("Exchange hashpartitioning") < text.index("partial_min")  # printed top down
    assert text.count("Exchange hashpartitioning") == 1


def test_claims_of_a_hot_patient_are_split(spark, tmp_path):
    """One patient id with a third of the claims, and another third without any id."""
    encounters = spark.range(30000).select(
        F.concat(F.lit("e"), "id").alias("encounter_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("p"), F.col("id"))).alias("patient_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("provider_id", "payer_id", "encounter_class", "description")],
        *[F.lit(1).alias(c) for c in ("encounter_year", "encounter_month")],
        F.current_date().alias("encounter_date"), F.rand(1).alias("duration_hours"),
        *[F.rand(2).cast("decimal(18,2)").alias(c) for c in ("total_claim_cost", "payer_coverage", "out_of_pocket")])
    patients = spark.range(30000).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("patient_id"),
        *[F.lit("x").alias(c) for c in ("gender", "race", "ethnicity", "state")], F.lit(30).cast("bigint").alias("age_years"))
    encounters.repartition(8).write.parquet(f"{tmp_path}/e")
    patients.repartition(8).write.parquet(f"{tmp_path}/p")
    with settings(
            spark, spark__sql__autoBroadcastJoinThreshold="-1",
            spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
            spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="40KB",
            spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
            spark__sql__adaptive__coalescePartitions__enabled="false"):
        mart = claims_mart(spark.read.parquet(f"{tmp_path}/e"), spark.read.parquet(f"{tmp_path}/p"))
        counts = {r.known: r["count"] for r in mart.groupBy(F.col("state").isNotNull().alias("known")).count().collect()}
        assert counts == {True: 20000, False: 10000}
        mart.write.format("noop").mode("overwrite").save()
        rows = mart.collect()
        assert len(rows) == 30000
        assert "SortMergeJoin(skew=true)" in plan(mart, "simple")


def test_distinct_counts_of_a_hot_provider_spread_over_patients(ws):
    text = plan(QUERIES["top_providers"](ws), "simple")
    assert re.search(r"Exchange hashpartitioning\(provider_id#\d+, .*patient_id#\d+", text)


@pytest.mark.parametrize("name", ["top_providers", "provider_leaderboard"])
def test_provider_lists_read_the_claims_twice_and_aggregate_them_once(ws, name):
    text = plan(QUERIES[name](ws), "simple")
    assert text.count("FileScan") == 2
    assert len(re.findall(r"HashAggregate\(keys=\[provider_id#\d+\], functions=\[partial_", text)) == 1


def test_written_day_has_no_extra_sort_or_shuffle(spark, ws):
    text = plan(ws.transformed("conditions"), "simple")
    assert "Exchange" not in text and "Sort" not in text


def test_few_of_many_files_hold_the_newest_claims_or_one_patient(spark, ws, tmp_path):
    with settings(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="16"):
        in_date_order(ws.claims()).write.parquet(f"{tmp_path}/claims")
        in_patient_order(ws.patients()).write.parquet(f"{tmp_path}/patients")
    claims, patients = spark.read.parquet(f"{tmp_path}/claims"), spark.read.parquet(f"{tmp_path}/patients")
    newest = claims.orderBy(F.desc_nulls_last("encounter_date")).limit(100).agg(F.min("encounter_date")).first()[0]
    files = claims.groupBy(F.input_file_name()).agg(F.max("encounter_date").alias("last"))
    assert files.count() >= 12 and files.where(F.col("last") >= F.lit(newest)).count() <= 3
    some = patients.agg(F.min("patient_id")).first()[0]
    files = patients.groupBy(F.input_file_name()).agg(F.min("patient_id").alias("low"), F.max("patient_id").alias("high"))
    assert files.count() >= 12 and files.where(F.lit(some).between(F.col("low"), F.col("high"))).count() == 1


def test_tier_and_group_are_added_behind_the_exchange_of_the_claims(spark, ws):
    staged = ws.staged("stg_encounters"), ws.staged("stg_patients")
    ordered, mart = claims_mart_in_date_order(*staged), claims_mart(*staged)
    (shuffled,) = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: rangepartitioning", plan(ordered))
    assert "cost_tier" not in shuffled and "age_group" not in shuffled
    assert ordered.schema == mart.schema
    assert ordered.exceptAll(mart).count() == mart.exceptAll(ordered).count() == 0
