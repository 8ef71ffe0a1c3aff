"""Scratch tables in the folder all executors share, and small helpers for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Most text that one step of a Python task holds as word lists; longer single texts are a step alone.
STEP_BYTES = 2 * 1024**2
# Most that one Arrow batch holds, unless a single row is larger.
BATCH_BYTES = 8 * 1024**2


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``, else in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """The rows as a written table: later steps read it, and a lost executor costs a re-read only.

    ``rows_per_file`` bounds the files, and so the batches in which Spark reads rows that are large themselves.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once per application: their Python need not have it installed.

    The archive itself is the driver's own; Spark's file server hands it out.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parents[1]
        archive = f"{tempfile.mkdtemp()}/{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo: the split of training and held-out rows."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_BYTES``.

    Two batches and their copies are held by the executor's JVM and by the Python worker at a time; Spark's default of 64 MB
    for each is too much beside small heaps. A smaller setting of the session stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is the empty text."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``most`` bytes of text each (or one longer text)."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for row, size in enumerate(sizes):
            if row > start and total + size > most:
                part = batch.slice(start, row - start)
                yield part, texts(part.column(column))
                start, total = row, 0
            total += size
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, texts(part.column(column))


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {column.lower() for column in columns}
    while name.lower() in taken:
        name += "_"
    return name
