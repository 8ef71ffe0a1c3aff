"""Alignment of the tokens of two tokenizers over the bytes of the same text.

Each tokenizer's tokens are rows of a 0/1 matrix whose columns are the bytes of the text, in compressed sparse rows
built by hand. Gustavson's row product of A and B transposed lets each token of A run over its bytes and, for each,
over the B tokens that hold it: the entries of a row are the B tokens it overlaps (overlap links), with the shared bytes as
values. Bytes where tokens of both end cut the tokens into groups; the product of the two group-incidence
matrices links all A and B tokens of a group (shared-group links). All texts of a step are one matrix, cut at their borders.

Three narrow passes with one small shuffle: texts become written rows of token ids; links are counted per pair of ids,
within a task first; the counts come back to the documents as sorted arrays of at most ``MOST_PAIRS`` pairs at a time, so what is
sent has a bound and all rows are read once more for each further block of pairs. No link is ever shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.llm.segments import vocabulary
from tallyward.llm.storage import STEP_BYTES, map_arrow, ship, steps, written

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
# Id pairs in one block: 24 bytes each are sent to the tasks.
MOST_PAIRS = 2_000_000
# Different pairs that a task counts before it hands them on.
HELD_PAIRS = 1_000_000
# Bytes of ids of A that are aligned at a time (or one longer text): some 100,000 tokens, whose matrices fit in a cache.
ALIGNED_BYTES = 256 * 1024


def _kind(size: int) -> type:
    return np.int32 if size < 1 << 31 else np.int64


@dataclass
class SparseRows:
    """Compressed sparse rows of zeros and ones: the columns of row i are ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> SparseRows:
        """Rows that follow one another, each over its next ``length`` columns: tokens over bytes, groups over tokens."""
        starts = np.concatenate([[0], np.cumsum(lengths)])
        return cls(starts, np.arange(starts[-1], dtype=_kind(starts[-1])), int(starts[-1]))

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1, dtype=_kind(self.width)), np.diff(self.starts))

    def transposed(self) -> SparseRows:
        """Counting sort by column; entries of one column stay in the order of their rows."""
        counts = np.bincount(self.columns, minlength=self.width)
        starts = np.concatenate([[0], np.cumsum(counts)])
        rows = self.rows()
        in_order = len(rows) < 2 or (self.columns[1:] >= self.columns[:-1]).all()
        return SparseRows(starts, rows if in_order else rows[np.argsort(self.columns, kind="stable")], len(self.starts) - 1)

    def times(self, other: SparseRows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gustavson's row products ``self @ other`` as (row, column, value), in order of row and column.

        For each entry (i, k) of this matrix row k of the other is added to row i of the product. Entries of a row
        come in order here, as both matrices are made of stretches, so equal ones are neighbours and are summed.
        """
        taken = np.diff(other.starts)[self.columns]
        if (taken == 1).all():  # each byte lies in one token
            row, column = self.rows(), other.columns[other.starts[self.columns]]
        else:
            row = np.repeat(self.rows(), taken)
            first = np.repeat(other.starts[self.columns] - np.concatenate([[0], np.cumsum(taken)[:-1]]), taken)
            column = other.columns[first + np.arange(len(first))]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (column[1:] != column[:-1])])) if len(row) else np.empty(0, int)
        return row[new], column[new], np.diff(np.append(new, len(row)))


@dataclass
class Alignment:
    """Tokens of some documents, one document after the other, and what links them. ``a_starts`` and ``b_starts`` hold the first token
    of each group and, last, the number of tokens."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    links: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def of(cls, a_ids: np.ndarray, b_ids: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> Alignment:
        """Both tokenizers' tokens cover the same bytes; documents end where tokens of both end."""
        _, a_last, b_last = np.intersect1d(np.cumsum(a_lengths), np.cumsum(b_lengths), assume_unique=True, return_indices=True)
        links = SparseRows.of_lengths(a_lengths).times(SparseRows.of_lengths(b_lengths).transposed())
        return cls(a_ids, b_ids, np.concatenate([[0], a_last + 1]), np.concatenate([[0], b_last + 1]), links)

    def shared_group_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a token, b token, 1) for all tokens of the two that lie in one group."""
        a, b = (SparseRows.of_lengths(np.diff(starts)) for starts in (self.a_starts, self.b_starts))
        return a.transposed().times(b)

    def keys(self) -> np.ndarray:
        """The id pair of each overlap link as one number."""
        a, b, _ = self.links
        return self.a_ids[a].astype(np.int64) << 16 | self.b_ids[b]


def _tokenized(batches: Iterator[pa.RecordBatch], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    a_tokens, b_tokens = vocabulary("bytes", names[0]), vocabulary("pieces", names[1])
    for batch, values in steps(batches, "text", 2 * ALIGNED_BYTES):
        texts = [" " + value.decode("utf-8", "replace") for value in values]
        a_rows, b_rows = [], []
        for text, a, b in zip(texts, a_tokens.encode(texts), b_tokens.encode(texts)):
            whole = text.encode()
            same = len(text) > 1 and a_tokens.decode(a) == whole == b_tokens.decode(b)
            a_rows.append(a.tobytes() if same else b"")
            b_rows.append(b.tobytes() if same else b"")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a_rows, pa.binary()), pa.array(b_rows, pa.binary())],
                                         ["doc_id", "a_ids", "b_ids"])


def tokenize_both(docs: DataFrame, byte_tokenizer: str = BYTE_TOKENIZER, piece_tokenizer: str = PIECE_TOKENIZER) -> DataFrame:
    """doc_id, a_ids, b_ids: little-endian 16-bit ids of the text with a space before it.

    Null and empty texts have none, nor have texts whose bytes either tokenizer does not give back.
    """
    ship(docs.sparkSession)
    names = (byte_tokenizer, piece_tokenizer)
    return map_arrow(docs.select("doc_id", "text"), lambda batches: _tokenized(batches, names), T.StructType([
        docs.schema["doc_id"], T.StructField("a_ids", T.BinaryType()), T.StructField("b_ids", T.BinaryType())]))


def _aligned(batches: Iterator[pa.RecordBatch], names: tuple[str, str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Alignment]]:
    """Rows, how many tokens of A and of B each of them has, and the alignment of all of them."""
    a_lengths, b_lengths = vocabulary("bytes", names[0]).lengths, vocabulary("pieces", names[1]).lengths
    for part, a_rows in steps(batches, "a_ids", ALIGNED_BYTES):
        b_rows = part.column("b_ids").to_pylist()
        a, b = (np.frombuffer(b"".join(rows), "<u2").astype(np.int64) for rows in (a_rows, b_rows))
        sizes = [np.array([len(row) // 2 for row in rows], np.int64) for rows in (a_rows, b_rows)]
        yield part, *sizes, Alignment.of(a, b, a_lengths[a], b_lengths[b])


def _added(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, inverse, np.concatenate([p[1] for p in pairs]))
    return keys, sums


def _count_batch(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), STEP_BYTES // 16):
        part = slice(at, at + STEP_BYTES // 16)
        yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(counts[part])], ["pair", "n"])


def _counted(batches: Iterator[pa.RecordBatch], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    held = (np.empty(0, np.int64), np.empty(0, np.int64))
    for *_, found in _aligned(batches, names):
        held = _added([held, np.unique(found.keys(), return_counts=True)])
        if len(held[0]) > HELD_PAIRS:
            yield from _count_batch(*held)
            held = (held[0][:0], held[1][:0])
    yield from _count_batch(*held)


def link_counts(tokens: DataFrame, byte_tokenizer: str = BYTE_TOKENIZER, piece_tokenizer: str = PIECE_TOKENIZER) -> DataFrame:
    """(pair, a_id, b_id, n_links, is_best) for each pair of ids that any link joins, over all rows of ``tokenize_both``.

    ``pair`` is a_id * 65536 + b_id. is_best: no other id of A is linked with b_id more often (ties are all best). The
    counts of a task are summed in it first. One row per id of B, no more than its vocabulary has, is joined back.
    """
    names = (byte_tokenizer, piece_tokenizer)
    counts = written(map_arrow(tokens.select("a_ids", "b_ids"), lambda batches: _counted(batches, names), "pair LONG, n LONG")
                     .groupBy("pair").agg(F.sum("n").alias("n_links")), "link-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(65535))
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("n_links").alias("most"))
    return (counts.withColumn("b_id", b_id).join(F.broadcast(most), "b_id")
            .select("pair", F.shiftright("pair", 16).cast("int").alias("a_id"), F.col("b_id").cast("int"), "n_links",
                    (F.col("n_links") == F.col("most")).alias("is_best")))


class Decimals:
    """Ids in decimal with the mark that follows each."""

    def __init__(self, size: int):
        self.size = size
        self.table = [str(i).encode() + mark for mark in (b",", b"|", b";") for i in range(size)]

    def groups(self, found: Alignment, a_sizes: np.ndarray, b_sizes: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each row."""
        in_a, in_b = np.diff(found.a_starts), np.diff(found.b_starts)
        codes = np.empty(len(found.a_ids) + len(found.b_ids), np.int64)
        codes[np.arange(len(found.a_ids)) + np.repeat(found.b_starts[:-1], in_a)] = found.a_ids
        codes[np.arange(len(found.b_ids)) + np.repeat(found.a_starts[1:], in_b)] = found.b_ids
        codes[found.a_starts[1:] + found.b_starts[:-1] - 1] += self.size  # the last token of A in its group
        codes[found.a_starts[1:] + found.b_starts[1:] - 1] += 2 * self.size  # the last token of B
        words = list(map(self.table.__getitem__, codes.tolist()))
        ends = np.cumsum(a_sizes + b_sizes).tolist()
        return [b"".join(words[start:end])[:-1] for start, end in zip([0, *ends], ends)]


def _summed(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    sums = np.zeros(rows, np.int64)
    np.add.at(sums, row, values)
    return sums


def _description(part: pa.RecordBatch, a_sizes: np.ndarray, b_sizes: np.ndarray, found: Alignment, decimals: Decimals) -> dict[str, pa.Array]:
    rows = part.num_rows
    a_row = np.repeat(np.arange(rows), a_sizes)
    group_row = a_row[found.a_starts[:-1]]
    in_both = np.diff(found.a_starts) * np.diff(found.b_starts)
    digests = [hashlib.sha256(text).hexdigest() if text else "" for text in decimals.groups(found, a_sizes, b_sizes)]
    counts = {"n_a": a_sizes, "n_b": b_sizes, "n_groups": np.bincount(group_row, minlength=rows),
              "n_links": np.bincount(a_row[found.links[0]], minlength=rows), "n_group_links": _summed(in_both, group_row, rows)}
    return {name: pa.array(values, pa.int64()) for name, values in counts.items()} | {"groups_sha256": pa.array(digests, pa.string())}


def _weights(part: pa.RecordBatch, a_sizes: np.ndarray, found: Alignment, block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    keys, counts, best = block
    if not len(keys):
        return {name: np.zeros(part.num_rows, np.int64) for name in ("n_best", "count_sum")}
    wanted = found.keys()
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    row = np.repeat(np.arange(part.num_rows), a_sizes)[found.links[0]][hit]
    return {"n_best": _summed(best[at[hit]], row, part.num_rows), "count_sum": _summed(counts[at[hit]], row, part.num_rows)}


def _measured(batches: Iterator[pa.RecordBatch], names: tuple[str, str], block: Broadcast) -> Iterator[pa.RecordBatch]:
    """All columns, with what the first block of pairs gives."""
    decimals = Decimals(max(len(vocabulary("bytes", names[0]).bytes), len(vocabulary("pieces", names[1]).bytes)))
    for part, a_sizes, b_sizes, found in _aligned(batches, names):
        weights = _weights(part, a_sizes, found, block.value)
        columns = _description(part, a_sizes, b_sizes, found, decimals) | {n: pa.array(w, pa.int64()) for n, w in weights.items()}
        yield pa.RecordBatch.from_arrays([*part.columns, *columns.values()], [*part.schema.names, *columns])


def _weighed(batches: Iterator[pa.RecordBatch], names: tuple[str, str], block: Broadcast) -> Iterator[pa.RecordBatch]:
    """The columns that are there, with what another block of pairs adds."""
    for part, a_sizes, _, found in _aligned(batches, names):
        weights = _weights(part, a_sizes, found, block.value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column.to_numpy(zero_copy_only=False) + weights[name], pa.int64()) if name in weights else column
             for name, column in zip(part.schema.names, part.columns)], part.schema.names)


def _with_counts(tokens: DataFrame, counts: DataFrame, names: tuple[str, str]) -> DataFrame:
    """All columns of all rows; one pass over the rows for each block of pairs."""
    spark = tokens.sparkSession
    blocks = max(1, -(-counts.count() // MOST_PAIRS))
    longs = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_group_links")]
    schema = T.StructType([*tokens.schema.fields, *longs, T.StructField("groups_sha256", T.StringType()),
                           *(T.StructField(c, T.LongType()) for c in ("n_best", "count_sum"))])
    rows = tokens
    for number in range(blocks):
        block = counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == number).select("pair", "n_links", "is_best").orderBy("pair").toArrow()
        keys, values, best = (block.column(i).to_numpy() for i in range(3))
        sent = spark.sparkContext.broadcast((keys, values, best.astype(np.int64)))
        step = _weighed if number else _measured
        rows = map_arrow(rows, lambda batches, step=step, sent=sent: step(batches, names, sent), schema)
        if number + 1 < blocks:
            rows = written(rows, "aligned")
            sent.unpersist()
    return rows


def align_documents(docs: DataFrame, byte_tokenizer: str = BYTE_TOKENIZER, piece_tokenizer: str = PIECE_TOKENIZER) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links.

    A pair of ids counts how many overlap links of the whole table join it; n_best are the links of a document whose count is
    the highest that their id of B has (ties included), count_sum the sum of the counts over its links, n_group_links its
    shared-group links. Null and empty texts, and texts whose bytes a tokenizer does not give back, have no tokens: zeros and
    an empty digest. Texts of any length are aligned whole; repeated rows are documents of their own and
    count each; an empty table gives an empty result; other columns are not read.
    """
    names = (byte_tokenizer, piece_tokenizer)
    tokens = written(tokenize_both(docs, *names), "tokens")
    counts = written(link_counts(tokens, *names), "link-pairs")
    return _with_counts(tokens, counts, names).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


def _linked(batches: Iterator[pa.RecordBatch], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    for part, a_sizes, b_sizes, found in _aligned(batches, names):
        a_row, b_row = (np.repeat(np.arange(part.num_rows), sizes) for sizes in (a_sizes, b_sizes))
        a_first, b_first = (np.concatenate([[0], np.cumsum(sizes)[:-1]]) for sizes in (a_sizes, b_sizes))
        for kind, (a, b, n) in (("overlap", found.links), ("group", found.shared_group_links())):
            for at in range(0, len(a), STEP_BYTES // 64):
                x, y, shared = (values[at:at + STEP_BYTES // 64] for values in (a, b, n))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(a_row[x])), pa.array([kind] * len(x)), pa.array(x - a_first[a_row[x]]),
                     pa.array(y - b_first[b_row[y]]), pa.array(found.a_ids[x]), pa.array(found.b_ids[y]), pa.array(shared)],
                    ["doc_id", "kind", "a_position", "b_position", "a_id", "b_id", "value"])


def token_links(tokens: DataFrame, byte_tokenizer: str = BYTE_TOKENIZER, piece_tokenizer: str = PIECE_TOKENIZER) -> DataFrame:
    """One row per link of ``tokenize_both`` rows: kind ``overlap`` (value: shared bytes) or ``group`` (value 1)."""
    names = (byte_tokenizer, piece_tokenizer)
    schema = T.StructType([tokens.schema["doc_id"], T.StructField("kind", T.StringType()),
                           *(T.StructField(c, T.LongType()) for c in ("a_position", "b_position", "a_id", "b_id", "value"))])
    return map_arrow(tokens.select("doc_id", "a_ids", "b_ids"), lambda batches: _linked(batches, names), schema)
