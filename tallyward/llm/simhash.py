"""SimHash near-duplicates through segment popcounts.

A fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, and of two vectors at most
three apart one half (16 segments) differs by at most one. So each half is a grid: a fingerprint
owns its cell and probes the neighbours one step up in one dimension, pairs meet in a cell, and an
exact bit comparison follows. Only distinct fingerprints enter, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.llm.components import connected_components, star_forest
from tallyward.llm.storage import map_arrow, steps, written

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 3
# Owners of one cell that one task compares; a fuller cell is dealt out in pairs of blocks.
CELL_OWNERS = 2048
_WORDS_AT_ONCE = 1 << 16
_PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: bytes) -> int:
    """64-bit SimHash over all word shingles of a UTF-8 text; a text without words gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    width = min(SHINGLE_WORDS, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    first = starts[: len(words) - width + 1]
    last = (starts + lengths)[width - 1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), _WORDS_AT_ONCE):
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(
            first[at:at + _WORDS_AT_ONCE].tolist(), last[at:at + _WORDS_AT_ONCE].tolist())], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view(np.int64)[0])


def _with_fingerprints(batches: Iterator[pa.RecordBatch], text: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch, values in steps(batches, text):
        found = pa.array([fingerprint(value) for value in values], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "simhash") -> DataFrame:
    """``docs`` with one more column, the 64 bits of the fingerprint as a signed long."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return map_arrow(docs, lambda batches: _with_fingerprints(batches, text, name), schema)


def _near(cell: np.ndarray, owner: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between each owner and all rows of its cell; rows are in order of cell."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(cell)]))
    size = np.diff(np.r_[starts, len(cell)])
    rows = np.flatnonzero(owner)
    rows = rows[size[group[rows]] > 1]
    ends = np.cumsum(size[group[rows]])
    left, right = [], []
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS_AT_ONCE, "right")))
        part = rows[at:to]
        count = size[group[part]]
        a = np.repeat(part, count)
        b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[group[part]], count)
        close = (np.bitwise_count(bits[a] ^ bits[b]) <= distance) & (bits[a] != bits[b])
        left.append(bits[a[close]])
        right.append(bits[b[close]])
        at = to
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)


def _cell_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """A forest of links for each run of whole cells; the last cell of a batch waits for the next one."""
    rest = None
    for batch in batches:
        now = tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "owner", "fp"))
        now = now if rest is None else tuple(np.concatenate(pair) for pair in zip(rest, now))
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        rest = tuple(x[cut:] for x in now)
        if cut:
            yield from _forest(*(x[:cut] for x in now), distance)
    if rest is not None:
        yield from _forest(*rest, distance)


def _forest(cell, owner, fp, distance) -> Iterator[pa.RecordBatch]:
    a, b = _near(cell, owner, fp.astype(np.int64).view(np.uint64), distance)
    if len(a):
        child, root = star_forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], ["a", "b"])


def _neighbours(cell: str) -> str:
    """SQL: the cells one step up in one dimension (a two-bit segment counts at most two)."""
    return (f"filter(transform(sequence(0, 15), i -> if((shiftright({cell}, 2 * i) & 3) < 2, "
            f"{cell} + shiftleft(1L, 2 * i), null)), c -> c is not null)")


def _cells(prints: DataFrame) -> DataFrame:
    """(half, own cell, fp): two rows for each fingerprint."""
    halves = prints.select("fp", F.expr(
        "posexplode(array(shiftrightunsigned(fp, 32), fp & 4294967295L)) as (half, bits)"))
    return halves.select("half", F.expr("bits - (shiftright(bits, 1) & 1431655765L)").alias("own"), "fp")


def fingerprint_links(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at most ``distance`` (up to 3) bits apart.

    Not every link is listed: each task gives a forest with the same components, so a dense group
    of thousands of near copies costs as many rows as it has members.
    """
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"distance must be between 0 and {MAX_DISTANCE}")
    own = _cells(prints)
    full = own.groupBy("half", F.col("own").alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > CELL_OWNERS)
    spread = full.select("half", F.expr(f"explode(concat(array(cell), {_neighbours('cell')})) as cell"), "n")
    blocks = spread.groupBy("half", "cell").agg(F.ceil(F.sum("n") / CELL_OWNERS).cast("int").alias("n_blocks"))
    rows = own.select("half", "fp", F.expr(f"posexplode(concat(array(own), {_neighbours('own')})) as (step, cell)"))
    # A full cell's rows go to every pair of blocks that theirs is part of; all others stay in one piece.
    dealt = (rows.join(blocks, ["half", "cell"], "left")
             .withColumn("block", F.expr("if(n_blocks is null, 0, cast(pmod(xxhash64(fp), n_blocks) as int))"))
             .select("half", "cell", "step", "fp", F.expr(
                 "explode(transform(sequence(0, coalesce(n_blocks, 1) - 1), "
                 "o -> shiftleft(least(o, block), 15) + greatest(o, block))) as shard")))
    sorted_rows = (dealt.select(F.xxhash64("half", "cell", "shard").alias("cell"), (F.col("step") == 0).alias("owner"), "fp")
                   .repartition("cell").sortWithinPartitions("cell"))
    return map_arrow(sorted_rows, lambda batches: _cell_links(batches, distance), "a BIGINT, b BIGINT")


def simhash_components(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(simhash, root, component_id) for each distinct fingerprint of ``prints`` (doc_id, simhash).

    ``root`` is the component's least fingerprint, ``component_id`` the smallest non-null doc_id
    reachable over links (null if there is none).
    """
    distinct = written(prints.groupBy("simhash").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    links = fingerprint_links(distinct.select(F.col("simhash").alias("fp")), distance)
    found = connected_components(links).toDF("simhash", "root")
    rooted = written(
        distinct.join(found, "simhash", "left").withColumn("root", F.coalesce("root", "simhash")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("simhash", "root", "component_id")


def simhash_near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts, and texts of white space alone, have fingerprint zero and link like any
    other. Repeated rows give repeated results. A null doc_id is never a component's name; a
    component of nulls alone has a null one. Columns other than doc_id and text are not read.
    """
    prints = written(with_fingerprints(docs.select("doc_id", "text")).select("doc_id", "simhash"), "simhash")
    named = simhash_components(prints, distance)
    return prints.join(named, "simhash").select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, one of them if it repeats.

    A component of null ids alone keeps one row. All columns stay as they are.
    """
    name = "simhash"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    marked = written(with_fingerprints(docs, name=name), "marked")
    prints = marked.select("doc_id", F.col(name).alias("simhash"))
    named = simhash_components(prints, distance)
    keep = (prints.join(named, "simhash").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root").agg(F.min("doc_id").alias("keep_id"), F.min("simhash").alias("keep_print")))
    kept = marked.alias("m").join(
        keep.select("keep_id", "keep_print").alias("k"),
        F.col("m.doc_id").eqNullSafe(F.col("k.keep_id")) & (F.col(f"m.{name}") == F.col("k.keep_print")),
        "left_semi")
    one = Window.partitionBy("doc_id", name).orderBy(F.lit(1))
    return kept.withColumn(f"{name}_no", F.row_number().over(one)).where(f"{name}_no = 1").select(*docs.columns)
