"""Tables that are replaced while they are in use."""

import pytest
from pyspark.sql import functions as F

from tallyward.sources import warehouse as w


@pytest.fixture()
def database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS swapped")
    yield "swapped"
    spark.sql("DROP DATABASE swapped CASCADE")


def rows(spark, name="swapped.t"):
    return sorted(map(tuple, spark.table(name).collect()))


def failing(spark):
    return spark.range(8, numPartitions=4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("task fails"))).otherwise(F.col("id")).cast("bigint").alias("id"))


@pytest.mark.parametrize("buckets", [None, (3, "id")])
@pytest.mark.parametrize("own_root", [True, False])
def test_a_failing_write_leaves_the_old_rows(spark, database, tmp_path, buckets, own_root):
    root = str(tmp_path) if own_root else None
    assert w.replace_table(spark.range(2), database, "t", root, buckets) == 2
    before = w.table_location(spark, "swapped.t")
    with pytest.raises(Exception, match="task fails"):
        w.replace_table(failing(spark), database, "t", root, buckets)
    assert rows(spark) == [(0,), (1,)] and w.table_location(spark, "swapped.t") == before
    assert [t.name for t in spark.catalog.listTables(database) if not t.isTemporary] == ["t"]
    assert w.replace_table(spark.range(3), database, "t", root, buckets) == 3
    assert rows(spark) == [(0,), (1,), (2,)] and w.table_location(spark, "swapped.t") != before


def test_a_reader_that_has_begun_reads_the_old_rows_to_the_end(spark, database, tmp_path):
    w.replace_table(spark.range(5), database, "t", str(tmp_path))
    reading = spark.table("swapped.t")
    files = reading.inputFiles()
    w.replace_table(spark.range(9), database, "t", str(tmp_path))
    assert spark.read.parquet(*files).count() == 5 and spark.table("swapped.t").count() == 9
    w.replace_table(spark.range(1), database, "t", str(tmp_path))
    folders = list((tmp_path / "swapped" / "t").iterdir())
    assert len(folders) == 2  # what is in use and what was before


def test_new_columns_and_buckets_make_the_entry_anew(spark, database, tmp_path):
    w.replace_table(spark.range(2), database, "t", str(tmp_path))
    wider = spark.range(2).withColumn("note", F.lit("it's"))
    assert w.replace_table(wider, database, "t", str(tmp_path)) == 2
    assert spark.table("swapped.t").columns == ["id", "note"]
    w.replace_table(wider, database, "t", str(tmp_path), (2, "id"))
    described = {r.col_name: r.data_type for r in spark.sql("DESCRIBE TABLE EXTENDED swapped.t").collect()}
    assert described["Num Buckets"] == "2" and rows(spark) == [(0, "it's"), (1, "it's")]


def test_a_cached_mart_shows_the_new_rows_after_a_refresh(spark, database, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS swapped_marts")
    for mart in w.MARTS:
        w.replace_table(spark.range(2), "swapped_marts", mart, str(tmp_path))
    w.cache_marts(spark, database)
    assert spark.table("swapped_marts.mart_claims_summary").count() == 2
    w.replace_table(spark.range(4), "swapped_marts", "mart_claims_summary", str(tmp_path))
    w.refresh_marts(spark, database)
    assert spark.table("swapped_marts.mart_claims_summary").count() == 4
    spark.sql("DROP DATABASE swapped_marts CASCADE")


@pytest.mark.parametrize("buckets", [None, (2, "id")])
def test_warehouse_files_are_written_with_zstd(spark, database, tmp_path, buckets):
    assert w.replace_table(spark.range(5), database, "t", str(tmp_path), buckets) == 5
    files = list(tmp_path.rglob("*.parquet"))
    assert files and all(".zstd." in f.name for f in files)
    assert rows(spark) == [(i,) for i in range(5)]
