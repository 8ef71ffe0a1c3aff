"""Replacement that survives failing writes and swaps that are cut short."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyward.sources import swap
from tallyward.sources import zones as z

DAY, OTHER = dt.date(2024, 1, 5), dt.date(2024, 1, 6)


def frame(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "Id string").repartition(4)


def failing(spark):
    return frame(spark, *"abcdefgh").select(F.when(F.col("Id") == "h", F.raise_error(F.lit("task fails"))).otherwise(F.col("Id")).cast("string").alias("Id"))


def held(read, spark, root, day=DAY):
    return sorted(r.Id for r in read(spark, root, "t", day).collect())


KINDS = [(z.land_raw, z.read_raw_partition), (z.write_processed, z.read_processed_partition)]


@pytest.mark.parametrize(("write", "read"), KINDS)
def test_a_failing_write_leaves_the_old_day_whole(spark, tmp_path, write, read):
    root = str(tmp_path)
    write(frame(spark, "1", "2"), root, "t", DAY)
    with pytest.raises(Exception, match="task fails"):
        write(failing(spark), root, "t", DAY)
    assert held(read, spark, root) == ["1", "2"]
    assert not list((tmp_path / "_staged").iterdir())
    with pytest.raises(Exception, match="task fails"):
        write(failing(spark), root, "t", OTHER)
    with pytest.raises(FileNotFoundError):
        read(spark, root, "t", OTHER)


@pytest.mark.parametrize(("write", "read"), KINDS)
@pytest.mark.parametrize("moves", [0, 1, 2])
def test_a_swap_that_is_cut_short_is_finished_by_the_next_reader(spark, tmp_path, monkeypatch, write, read, moves):
    root, done = str(tmp_path), []
    write(frame(spark, "1", "2"), root, "t", DAY)
    move = swap.Store.move

    def killed(self, source, target):
        if "_intent" not in target:
            if len(done) == moves:
                raise KeyboardInterrupt
            done.append(target)
        move(self, source, target)

    monkeypatch.setattr(swap.Store, "move", killed)
    if moves < 2:
        with pytest.raises(KeyboardInterrupt):
            write(frame(spark, "3"), root, "t", DAY)
    else:
        write(frame(spark, "3"), root, "t", DAY)
    monkeypatch.undo()
    assert held(read, spark, root) == (["1", "2"] if moves == 0 else ["3"])  # whole, old or new
    swap.finish_swaps(spark, root)
    assert held(read, spark, root) == ["3"] and swap.finish_swaps(spark, root) == []


def test_an_unfinished_write_is_not_taken_for_a_day(spark, tmp_path):
    root = str(tmp_path)
    z.write_processed(frame(spark, "1"), root, "t", DAY)
    frame(spark, "9").write.parquet(f"{root}/_staged/abandoned/{z.day_key('t', DAY)}")
    assert swap.finish_swaps(spark, root) == [] and held(z.read_processed_partition, spark, root) == ["1"]
    assert {r.table_name: r.objects for r in z.day_objects(spark, root, ("t",), DAY).collect()}["t"] >= 1


def test_several_days_in_one_job_are_replaced_together(spark, tmp_path):
    root = str(tmp_path)
    z.write_days([(DAY, frame(spark, "1", "2")), (OTHER, frame(spark, "3"))], root, "t")
    with pytest.raises(Exception, match="task fails"):
        z.write_days([(DAY, frame(spark, "4")), (OTHER, failing(spark))], root, "t")
    assert held(z.read_processed_partition, spark, root) == ["1", "2"]
    z.write_days([(DAY, frame(spark, "4")), (OTHER, frame(spark).limit(0))], root, "t")
    assert held(z.read_processed_partition, spark, root) == ["4"]
    assert held(z.read_processed_partition, spark, root, OTHER) == ["3"]  # a day without rows is not touched


def test_a_place_without_commit_marker_is_refused(spark, tmp_path):
    def write(staged):
        (tmp_path / "x").mkdir(exist_ok=True)
        swap.Store(spark, staged).write(f"{staged}/t/part-0", "half")

    with pytest.raises(OSError, match="incomplete"):
        swap.replace_folders(spark, str(tmp_path), ["t"], write)
    assert not (tmp_path / "t").exists()
