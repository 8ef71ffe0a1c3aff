"""Session settings and the shared working folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# A shuffle partition of this size sorts in memory on a common executor and writes one decent file.
PARTITION_BYTES = 256 * 1024**2


def build_session(
    app_name: str = "tallyward", master: str | None = None, shuffle_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Session pinned to UTC; join strategies and final partition counts come from adaptive execution.

    Adaptive execution merges partitions but starts from a given number. ``shuffle_bytes``, the
    largest shuffle to expect (for the marts about the size of the encounters), sets that start.
    """
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_bytes:
        start = max(200, -(-shuffle_bytes // PARTITION_BYTES))
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(start))
        builder = builder.config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(PARTITION_BYTES))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named by ``spark.checkpoint.dir``, else the checkpoint directory set
    on the context, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Start later shuffles of this session with enough partitions for inputs of this size (never fewer than before)."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = -(-input_bytes // PARTITION_BYTES)
    if wanted > before:
        spark.conf.set(name, str(wanted))


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int) -> Iterator[None]:
    """``size_shuffles`` for a stretch of work: afterwards the session has the setting that it had before."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    size_shuffles(spark, input_bytes)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of a store that Spark reaches; nothing happens if it is absent."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
