"""Byte-level BPE of whole documents by content-defined chunks, and back.

A rolling hash over the bytes cuts a text where the hash of the last ``WINDOW`` bytes ends in zeros, so that copied
passages give the same chunks in whatever document they stand. Each different chunk is encoded once while a
worker keeps it. Tokens at the ends of a chunk depend on what stands beyond, so every join is repaired: the stretch from a space
before the join to a space behind it is encoded again, and taken when it agrees, token by token, with both
chunks over one more segment on either side. Where it does not, or a chunk has too few spaces, the chunks
become one and its joins are tried again, up to the whole text, so the ids are those of the whole text.

A task encodes the documents of its own input split; nothing is shuffled, and a lost task encodes the same split again. Chunks that
lie in splits of several tasks are encoded once for each Python worker that meets them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyward.llm.segments import Vocabulary, vocabulary
from tallyward.llm.storage import free_name, map_arrow, ship, steps

BYTE_BPE = "byte_bpe_50k.json"
WINDOW = 16
CHUNK_BITS = 10
LEAST_CHUNK = 256
# Text of chunks that one Python worker keeps; what is kept besides takes about three times as much.
KEPT_BYTES = 16 * 1024**2
_FACTOR = np.uint32(2654435761)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the ``WINDOW`` bytes that end there (fewer at the start)."""
    value = (data.astype(np.uint32) + np.uint32(1)) * _FACTOR
    value ^= value >> np.uint32(15)
    factor, reach = _FACTOR, 1
    while reach < WINDOW:
        later = value.copy()
        later[reach:] += value[:-reach] * factor
        with np.errstate(over="ignore"):
            factor = factor * factor
        value, reach = later, reach * 2
    return value


def chunks_of(text: bytes, cuts: np.ndarray) -> list[bytes]:
    """Chunks between those ``cuts`` that are ``LEAST_CHUNK`` bytes apart, moved to the start of a character."""
    chunks, start = [], 0
    for cut in cuts.tolist():
        if cut - start >= LEAST_CHUNK:
            while cut < len(text) and text[cut] & 0xC0 == 0x80:
                cut += 1
            if cut < len(text):
                chunks.append(text[start:cut])
                start = cut
    chunks.append(text[start:])
    return chunks


def cut_chunks(texts: list[bytes]) -> list[list[bytes]]:
    """All texts are hashed in one go; a window over the start of a text lies within its first chunk."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [[text] for text in texts]
    cuts = np.flatnonzero(rolling_hash(data) >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    ends = np.cumsum([len(text) for text in texts])
    parts = np.searchsorted(cuts, [0, *ends.tolist()])
    return [chunks_of(text, cuts[parts[i]:parts[i + 1]] - (ends[i] - len(text))) for i, text in enumerate(texts)]


@dataclass
class Chunk:
    """Ids of a chunk on its own. ``syncs``: tokens before its first two and its last two spaces that follow a printable ASCII
    character, with those places; None when there are fewer than three. ``inner``: what lies between the first and the last."""

    text: bytes
    ids: np.ndarray
    syncs: tuple | None
    inner: tuple | None = None


class ChunkEncoder:
    def __init__(self, tokens: Vocabulary):
        self.tokens = tokens
        self.known: dict[bytes, Chunk] = {}
        self.kept = 0

    def _printed(self, ids: np.ndarray) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids in decimal, their bytes."""
        return len(ids), b",".join(map(self.tokens.decimals.__getitem__, ids.tolist())), self.tokens.decode(ids)

    def _chunk(self, text: bytes, ids: np.ndarray) -> Chunk:
        data = np.frombuffer(text, np.uint8)
        places = np.flatnonzero((data[:-1] > 0x20) & (data[:-1] < 0x7F) & ((data[1:] == 0x20) | (data[1:] == 0x0A))) + 1
        if len(places) < 3:
            return Chunk(text, ids, None)
        places = places[[0, 1, -2, -1]]
        ends = np.cumsum(self.tokens.lengths[ids])
        before = np.searchsorted(ends, places) + 1
        if not np.array_equal(ends[before - 1], places):
            return Chunk(text, ids, None)
        at = before.tolist()
        return Chunk(text, ids, (places.tolist(), at), self._printed(ids[at[0]:at[3]]))

    def learn(self, texts: set[bytes]) -> dict[bytes, Chunk]:
        """Each different chunk, encoded unless it is known."""
        if self.kept > KEPT_BYTES:
            self.known, self.kept = {}, 0
        found = {text: self.known[text] for text in texts if text in self.known}
        new = [text for text in texts if text not in found]
        for text, ids in zip(new, self.tokens.encode([text.decode("utf-8", "replace") for text in new])):
            found[text] = chunk = self._chunk(text, ids)
            if len(text) <= KEPT_BYTES // 16:
                self.known[text] = chunk
                self.kept += len(text)
        return found

    def _agrees(self, left: Chunk, right: Chunk, seam: np.ndarray) -> np.ndarray | None:
        """Ids between the last space of ``left`` and the first of ``right``, if both chunks agree with the seam beside them."""
        (_, _, a1, a2), (_, _, i1, i2) = left.syncs
        (b1, b2, _, _), (j1, j2, _, _) = right.syncs
        before, after = left.ids[i1:i2], right.ids[j1:j2]
        if len(seam) < len(before) + len(after):
            return None
        stop = len(seam) - len(after)
        agree = np.array_equal(seam[:len(before)], before) and np.array_equal(seam[stop:], after)
        return seam[len(before):stop] if agree else None

    def pieces(self, documents: list[list[bytes]]) -> list[list[tuple[int, bytes, bytes]]]:
        """For each document (its chunks) the number, decimals and bytes of its ids, piece by piece."""
        done: list = [None] * len(documents)
        open_ones = dict(enumerate(documents))
        while open_ones:
            known = self.learn(set().union(*open_ones.values()))
            joins = {(left, right) for parts in open_ones.values() for left, right in zip(parts, parts[1:])}
            able = [(left, right) for left, right in joins if known[left].syncs and known[right].syncs]
            windows = [(left[known[left].syncs[0][2]:] + right[:known[right].syncs[0][1]]).decode("utf-8", "replace") for left, right in able]
            seams = {}
            for (left, right), ids in zip(able, self.tokens.encode(windows)):
                agreed = self._agrees(known[left], known[right], ids)
                if agreed is not None:
                    seams[left, right] = self._printed(agreed)
            for number, parts in list(open_ones.items()):
                merged = [parts[0]]
                for left, right in zip(parts, parts[1:]):
                    if (left, right) in seams:
                        merged.append(right)
                    else:
                        merged[-1] += right
                if len(merged) < len(parts):
                    open_ones[number] = merged
                else:
                    done[number] = self._assembled([known[part] for part in parts], seams)
                    del open_ones[number]
        return done

    def _assembled(self, parts: list[Chunk], seams: dict) -> list[tuple[int, bytes, bytes]]:
        if len(parts) == 1:
            return [self._printed(parts[0].ids)]
        pieces = [self._printed(parts[0].ids[:parts[0].syncs[1][0]])]
        for left, right in zip(parts, parts[1:]):
            pieces += [left.inner, seams[left.text, right.text]]
        return [*pieces, parts[-1].inner, self._printed(parts[-1].ids[parts[-1].syncs[1][3]:])]


_encoders: dict[str, ChunkEncoder] = {}


def chunk_encoder(name: str) -> ChunkEncoder:
    """One for each Python worker, kept for its later tasks."""
    if name not in _encoders:
        _encoders[name] = ChunkEncoder(vocabulary("bytes", name, special=True))
    return _encoders[name]


def _encoded(batches: Iterator[pa.RecordBatch], text: str, name: str, columns: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = chunk_encoder(name)
    for batch, values in steps(batches, text):
        counts, listed, decoded, ids = [], [], [], []
        for pieces in encoder.pieces(cut_chunks(values)):
            pieces = [piece for piece in pieces if piece[0]]
            decimals = b",".join(piece[1] for piece in pieces)
            counts.append(sum(piece[0] for piece in pieces))
            listed.append(hashlib.sha256(decimals).hexdigest())
            joined = b"".join(piece[2] for piece in pieces)
            decoded.append(hashlib.sha256(joined.decode("utf-8", "replace").encode()).hexdigest())
            if with_ids:
                ids.append(np.array(decimals.split(b",") if decimals else [], "<u4").tobytes())
        arrays = [pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
        arrays += [pa.array(ids, pa.binary())] if with_ids else []
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *columns])


def encode_documents(docs: DataFrame, text: str = "text", tokenizer: str = BYTE_BPE, with_ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids (little-endian uint32).

    ``tokenizer`` is the path of a byte-level vocabulary or the name of an installed one, opened where the tasks run.
    The ids are those of the whole text, strings of special tokens being those tokens; decoded_sha256 is the digest of what the ids stand for. Null
    and empty texts have no ids (digests of the empty text); texts of any length are encoded whole, and one
    without spaces is one chunk; repeated rows give repeated results, an empty table an empty one. New
    columns whose names are taken get an underscore.
    """
    ship(docs.sparkSession)
    columns: list[str] = []
    for name in ("n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])):
        columns.append(free_name([*docs.columns, *columns], name))
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.BinaryType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(columns, kinds))])
    return map_arrow(docs, lambda batches: _encoded(batches, text, tokenizer, columns, with_ids), schema)


def _decoded(batches: Iterator[pa.RecordBatch], ids: str, name: str, column: str) -> Iterator[pa.RecordBatch]:
    tokens = vocabulary("bytes", name, special=True)
    for batch in batches:
        texts = [None if v is None else tokens.decode(np.frombuffer(v, "<u4")).decode("utf-8", "replace")
                 for v in batch.column(ids).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column])


def decode_documents(encoded: DataFrame, ids: str = "ids", tokenizer: str = BYTE_BPE, column: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids (little-endian uint32); null ids give null, no ids the empty text.

    Bytes that are no UTF-8, as of ids cut within a character, become U+FFFD.
    """
    ship(encoded.sparkSession)
    column = free_name(encoded.columns, column)
    schema = T.StructType([*encoded.schema.fields, T.StructField(column, T.StringType())])
    return map_arrow(encoded, lambda batches: _decoded(batches, ids, tokenizer, column), schema)
