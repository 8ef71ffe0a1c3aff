"""Benchmark decontamination by Wu-Manber search over words.

The benchmark's windows are the patterns, words the symbols. A table over hashed blocks of two words
says how far the search may jump without missing a window; where it says zero, the block is the
suffix of some windows, its bucket lists them, and each is compared word by word. Many stretches
of the text advance together as numpy lanes.

Documents are not shuffled. The benchmark reaches the tasks in blocks of about ``BLOCK_BYTES`` of text, each different text
once; the tables take some six to ten times that. A larger benchmark means one more narrow pass for each block, and the passes
add up their hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.llm.storage import free_name, map_arrow, steps, texts

WINDOW = 10
BLOCK_BYTES = 32 * 1024**2
# What an item takes besides its text.
ITEM_BYTES = 100
_LANE = 128
# Separators become spaces, A-Z lower case; bytes of non-ASCII letters stay.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def _mixed(stream: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the window at each start."""
    value = np.zeros(len(starts), np.uint64)
    for offset in range(length):
        value = (value ^ stream[starts + offset].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value


def different_windows(stream: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the different windows, number of its window for each start). Equal hashes are compared word by word."""
    mixed = _mixed(stream, starts, length)
    order = np.argsort(mixed, kind="stable")
    new = np.concatenate([[True], mixed[order][1:] != mixed[order][:-1]]) if len(order) else np.empty(0, bool)
    group = np.cumsum(new, dtype=np.int32) - 1
    first = starts[order[new]]
    if all((stream[starts[order] + offset] == stream[first[group] + offset]).all() for offset in range(length)):
        number = np.empty(len(starts), np.int32)
        number[order] = group
        return first, number
    _, index, number = np.unique(stream[starts[:, None] + np.arange(length)], axis=0, return_index=True, return_inverse=True)
    return starts[index], number.astype(np.int32)


class WuManber:
    """Windows of one length, searched in an array of word numbers (0: in no window).

    Windows are places in a ``stream`` of word numbers, so a word of the benchmark is stored once, not once for each
    window that holds it. A matrix of windows, one a row, will do as well.
    """

    def __init__(self, stream: np.ndarray, starts: np.ndarray | None = None, length: int = 0):
        if starts is None:
            starts, length, stream = np.arange(len(stream)) * stream.shape[1], stream.shape[1], stream.ravel()
        self.stream, self.starts, self.length = stream, starts.astype(np.int32), length
        self.block = min(2, length)
        self.mask = (1 << max(12, len(starts).bit_length())) - 1
        self.shift = np.full(self.mask + 1, length - self.block + 1, np.int16)
        for end in range(self.block - 1, length):
            np.minimum.at(self.shift, self._blocks(stream, self.starts + end), np.int16(length - 1 - end))
        suffix = self._blocks(stream, self.starts + (length - 1))
        self.order = np.argsort(suffix, kind="stable").astype(np.int32)
        self.bucket = np.searchsorted(suffix[self.order], np.arange(self.mask + 2)).astype(np.int32)

    def _blocks(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = words[end].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if self.block == 2:
            value ^= words[end - 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((value >> np.uint64(29)) & np.uint64(self.mask)).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence, overlapping ones included."""
        starts, found = [], []
        at = np.arange(self.length - 1, len(text), _LANE)
        stop = np.minimum(at + _LANE, len(text))
        while len(at):
            block = self._blocks(text, at)
            jump = self.shift[block]
            here = jump == 0
            if here.any():
                ends, key = at[here], block[here]
                count = (self.bucket[key + 1] - self.bucket[key]).astype(np.int64)
                which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - self.bucket[key], count)
                pattern = self.order[which]
                begin = np.repeat(ends, count) - self.length + 1
                same = np.ones(len(begin), bool)
                for offset in range(self.length):
                    same[same] = text[begin[same] + offset] == self.stream[self.starts[pattern[same]] + offset]
                starts.append(begin[same])
                found.append(pattern[same])
            at = at + np.maximum(jump, 1).astype(np.int64)
            going = at < stop
            at, stop = at[going], stop[going]
        return (np.concatenate(starts), np.concatenate(found)) if starts else (np.empty(0, int), np.empty(0, int))


class Benchmark:
    """Search tables of some benchmark items: word numbers, different windows by length, texts of each window, items of each text."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        place: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        for item, text in items:
            if text not in place:
                place[text] = len(self.items)
                self.items.append(set())
            if item is not None:
                self.items[place[text]].add(item)
        # A zero behind each text keeps windows from reaching across.
        rows = [np.fromiter((self.numbers.setdefault(w, len(self.numbers) + 1) for w in chain(words_of(text), (b"",))), np.int32) for text in place]
        stop = self.numbers.get(b"", 0)
        stream = np.concatenate(rows) if rows else np.empty(0, np.int32)
        stream[stream == stop] = 0
        sizes = np.array([len(row) - 1 for row in rows], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        widths = np.minimum(sizes, window)
        self.searches: list[WuManber] = []
        self.owners: list[tuple[np.ndarray, np.ndarray]] = []
        for width in sorted(set(widths.tolist()) - {0}):
            these = np.flatnonzero(widths == width)
            count = sizes[these] - width + 1
            text = np.repeat(these, count).astype(np.int32)
            starts = (np.arange(count.sum()) + np.repeat(first[these] - np.cumsum(count) + count, count)).astype(np.int32)
            different, number = different_windows(stream, starts, width)
            self.searches.append(WuManber(stream, different, width))
            order = np.argsort(number, kind="stable")
            self.owners.append((np.searchsorted(number[order], np.arange(len(different) + 1)).astype(np.int32), text[order]))

    def nbytes(self) -> int:
        """Bytes of the arrays; the stream counts once."""
        arrays = [a for s in self.searches for a in (s.starts, s.shift, s.order, s.bucket)] + [a for pair in self.owners for a in pair]
        return sum(a.nbytes for a in arrays) + (self.searches[0].stream.nbytes if self.searches else 0)

    def scan(self, documents: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """For each document which words are hit, and the items with occurring windows."""
        sizes = np.fromiter(map(len, documents), np.int64, len(documents))
        first = np.cumsum(sizes + 1) - sizes - 1
        # One unknown word between documents keeps windows from reaching across.
        text = np.fromiter(chain.from_iterable(
            chain(map(self.numbers.get, words, repeat(0)), (0,)) for words in documents), np.int32, int(sizes.sum()) + len(sizes))
        change = np.zeros(len(text) + 1, np.int64)
        items: list[set[str]] = [set() for _ in documents]
        for search, (begin, texts_of) in zip(self.searches, self.owners):
            starts, patterns = search.search(text)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + search.length, -1)
            document = np.searchsorted(first, starts, "right") - 1
            met = np.unique(document * len(search.starts) + patterns)
            document, pattern = met // max(1, len(search.starts)), met % max(1, len(search.starts))
            count = (begin[pattern + 1] - begin[pattern]).astype(np.int64)
            which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - begin[pattern], count)
            for owner, number in np.unique(np.stack([np.repeat(document, count), texts_of[which]], axis=1), axis=0).tolist():
                items[owner] |= self.items[number]
        hit = np.cumsum(change) > 0
        return [(hit[f:f + n], found) for f, n, found in zip(first.tolist(), sizes.tolist(), items)]


def _scan(batches: Iterator[pa.RecordBatch], tables: Broadcast, text: str, name: str) -> Iterator[pa.RecordBatch]:
    """Adds what this block of the benchmark hits to ``name``, a struct of word count, hit words and items."""
    for batch, values in steps(batches, text):
        found = tables.value.scan([words_of(value) for value in values])
        earlier = batch.column(name).to_pylist()
        rows = []
        for (hit, items), so_far in zip(found, earlier):
            if so_far and so_far["hits"]:
                hit = hit | np.unpackbits(np.frombuffer(so_far["hits"], np.uint8), count=len(hit)).astype(bool)
            rows.append({"n_words": len(hit), "n_hit": int(hit.sum()), "hits": np.packbits(hit).tobytes() if hit.any() else None,
                         "items": sorted(items | set((so_far or {}).get("items") or ()))})
        column = pa.array(rows, batch.schema.field(name).type)
        yield batch.set_column(batch.schema.get_field_index(name), batch.schema.field(name), column)


_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                       T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])


def _blocks(items: DataFrame) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark's different items in blocks of about ``BLOCK_BYTES``, each small enough to send to every task.

    The items of a text that many have are dealt to all blocks, the text with them.
    """
    known = items.where("text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("text") + ITEM_BYTES), F.lit(0))).first()[0]
    count = max(1, -(-size // BLOCK_BYTES))
    for block in range(count):
        part = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block) if count > 1 else known
        rows = part.toArrow()
        yield list(zip(rows.column("item").to_pylist(), texts(rows.column("text").combine_chunks())))


def mark_contamination(docs: DataFrame, items: DataFrame, name: str, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, n_hit, hits (a bit for each word, null if none), items.

    A word is a run of ASCII digits and letters (A-Z lower-cased) and non-ASCII characters. A window is
    ``window`` consecutive words of an item; an item of fewer words is one window, one of none has no
    window. A word inside any occurrence of a window is hit. ``items`` are the item_ids with occurring
    windows as strings, sorted; an item with a null id hits words but is not listed, repeated items
    count once, a null text has no words.
    """
    marked = docs.withColumn(name, F.lit(None).cast(_FOUND))
    for block in _blocks(items.select("item_id", "text")):
        tables = docs.sparkSession.sparkContext.broadcast(Benchmark(block, window))
        marked = map_arrow(marked, lambda batches, tables=tables: _scan(batches, tables, text, name), marked.schema)
    return marked


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``items_sha256`` is the hash of the comma-joined item_ids (of the empty text if there is none). Null
    and empty texts have no words and are clean; repeated rows give repeated results; an empty
    benchmark hits nothing. Other columns are not read.
    """
    found = mark_contamination(docs.select("doc_id", "text"), items, "found", window)
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark; their columns stay as they are."""
    name = free_name(docs.columns, "found")
    return mark_contamination(docs, items, name, window).where(F.col(name)["n_hit"] == 0).drop(name)

