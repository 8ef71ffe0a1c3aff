"""Hierarchical multi-length packing of tokenized documents.

Documents are routed to tiers by their length: stretches of a whole longest window stand alone, and
what remains goes to the tier of the smallest window that holds it. Each tier fills windows of its
own size, longest piece first; gaps take the longest piece that fits from the same and then from the
shorter tiers, and the last gap is closed by cutting a piece. So every window is full but the last
one of a task. Windows of one size are dealt to step groups of equal token counts in order of
their attention cost, back and forth, so that the groups cost about the same.

All of it happens where the text is read: a task packs the documents of its own input split, token ids
are never shuffled, and a lost task packs the same split again. Memory is bounded by ``HELD`` pieces a tier.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyward.llm.storage import map_arrow, steps

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16_384
END_ID = 1
# Pieces that wait in a tier before its windows are filled, and groups that share a deal.
HELD = 512
GROUPS = 4
_CACHED_WORDS = 500_000
# Words of these characters are cut here as the tokenizer cuts them (letters, single digits, other runs) and
# looked up by part; apostrophes, other scripts, fractions and control characters are left to the tokenizer.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
_SIMPLE = re.compile("[!-&(-~¡-±´-¸»¿-įı-ſ]+")
_PART = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Token ids of a text, word by word.

    The tokenizer never joins anything over white space, so the ids of a text are those of its words one after
    the other. Each word is tokenized once and then looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token."""
        stem = part.lower()
        if stem not in self.stems:
            letters = stem if stem.isascii() else "".join(map(self.letters.__getitem__, stem.encode()))
            ids = [token.id for token in self.model.tokenize(letters)]
            self.stems[stem] = struct.pack(f"<{len(ids)}I", *ids)
        return self.stems[stem]

    def learn(self, documents: list[list[bytes]]) -> None:
        new = set().union(*documents)
        if len(self.known) + len(self.stems) > _CACHED_WORDS:
            self.known.clear()
            self.stems.clear()
        new.difference_update(self.known.keys())
        odd = []
        for word in new:
            text = word.decode()
            if _SIMPLE.fullmatch(text):
                self.known[word] = b"".join(map(self._part, _PART.findall(text)))
            else:
                odd.append(word)
        for word, found in zip(odd, self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)):
            self.known[word] = struct.pack(f"<{len(found.ids)}I", *found.ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        documents = [text.split() for text in texts]
        self.learn(documents)
        return [b"".join(map(self.known.__getitem__, words)) for words in documents]


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each Python worker, kept for its later tasks."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


class Tier:
    """Pieces of at most ``window`` tokens, sorted by length."""

    def __init__(self, window: int):
        self.window = window
        self.pieces: list[tuple] = []

    def add(self, piece: tuple) -> None:
        insort(self.pieces, piece)

    def longest(self, most: int) -> tuple | None:
        at = bisect_right(self.pieces, (most, float("inf")))
        return self.pieces.pop(at - 1) if at else None


class Packer:
    """Windows of one task's documents. A piece is (length, serial, doc_id, start, doc_tokens, ids)."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_sequence: int):
        self.tiers = [Tier(window) for window in sorted(tiers)]
        self.windows = [tier.window for tier in self.tiers]
        self.step_tokens = step_tokens
        self.next_sequence = first_sequence
        self.next_group = first_sequence
        self.serial = 0
        self.filled: dict[int, list[list[tuple]]] = {window: [] for window in self.windows}
        self.rows: list[tuple] = []

    def _route(self, doc_id, start: int, total: int, ids: bytes) -> None:
        length = len(ids) // 4
        self.serial += 1
        piece = (length, self.serial, doc_id, start, total, ids)
        if length == self.windows[-1]:
            self._close(length, [piece])
        else:
            next(tier for tier in self.tiers if tier.window >= length).add(piece)

    def add(self, doc_id, ids: bytes) -> None:
        total, longest = len(ids) // 4, self.windows[-1]
        for start in range(0, total, longest):
            self._route(doc_id, start, total, ids[4 * start:4 * (start + longest)])
        for tier in self.tiers:
            if len(tier.pieces) >= HELD:
                self._fill(tier, HELD // 2)

    def _cut(self, piece: tuple, length: int) -> tuple:
        """The first ``length`` tokens; the rest is routed again."""
        _, serial, doc_id, start, total, ids = piece
        self._route(doc_id, start + length, total, ids[4 * length:])
        return (length, serial, doc_id, start, total, ids[:4 * length])

    def _fill(self, tier: Tier, keep: int) -> None:
        """Fills windows of the tier until at most ``keep`` of its pieces, or too few tokens, are left."""
        shorter = self.tiers[self.tiers.index(tier)::-1]
        left = sum(piece[0] for t in shorter for piece in t.pieces)
        while len(tier.pieces) > keep and left >= tier.window:
            window, gap = [], tier.window
            while gap:
                fits = next((p for t in shorter if (p := t.longest(gap))), None)
                if fits is None:
                    fits = self._cut(next(t for t in reversed(shorter) if t.pieces).pieces.pop(0), gap)
                window.append(fits)
                gap -= fits[0]
            left -= tier.window
            self._close(tier.window, window)

    def _close(self, window: int, pieces: list[tuple]) -> None:
        self.filled[window].append(pieces)
        if len(self.filled[window]) == GROUPS * max(1, self.step_tokens // window):
            self._deal(window)

    def _deal(self, window: int) -> None:
        """Windows by attention cost, dealt back and forth to groups of one step each."""
        ranked = sorted(self.filled[window], key=lambda pieces: -sum(p[0] ** 2 for p in pieces))
        groups = -(-len(ranked) // max(1, self.step_tokens // window))
        for rank, pieces in enumerate(ranked):
            turn, place = divmod(rank, groups)
            group = self.next_group + (groups - 1 - place if turn % 2 else place)
            offset = 0
            for length, _, doc_id, start, total, ids in pieces:
                self.rows.append((doc_id, start, length, zlib.crc32(ids), total, self.next_sequence, offset, window, group, ids))
                offset += length
            self.next_sequence += 1
        self.next_group += groups
        self.filled[window] = []

    def finish(self) -> None:
        """Each tier fills its own windows, what is left the largest it can; less than the smallest window is padded."""
        for tier in reversed(self.tiers):
            self._fill(tier, 0)
        for tier in reversed(self.tiers):
            rest = [piece for t in self.tiers for piece in t.pieces]
            for t in self.tiers:
                t.pieces = []
            rest.sort(key=lambda p: -p[0])
            while sum(p[0] for p in rest) >= tier.window:
                window, gap = [], tier.window
                while gap:
                    length, serial, doc_id, start, total, ids = rest.pop(0)
                    window.append((min(gap, length), serial, doc_id, start, total, ids[:4 * gap]))
                    if length > gap:
                        rest.insert(0, (length - gap, serial, doc_id, start + gap, total, ids[4 * gap:]))
                    gap -= min(gap, length)
                self._close(tier.window, window)
            for piece in rest:
                self.tiers[-1].add(piece)
        if self.tiers[-1].pieces:
            self._close(self.windows[-1], self.tiers[-1].pieces)
        for window in self.windows:
            if self.filled[window]:
                self._deal(window)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                     ("window", pa.int64()), ("step_group", pa.int64())])
_DDL = ("doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, "
        "offset BIGINT, window BIGINT, step_group BIGINT")


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(column, kind) for column, kind in zip(columns, _SCHEMA.types)]
    if not with_ids:
        return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)
    return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[-1], pa.binary())], [*_SCHEMA.names, "ids"])


def _pack(batches: Iterator[pa.RecordBatch], path: str, tiers, step_tokens, with_ids) -> Iterator[pa.RecordBatch]:
    tokens = word_tokens(path)
    end = np.array([END_ID], "<u4").tobytes()
    packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 32)
    for batch, values in steps(batches, "text"):
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(values)):
            packer.add(doc_id, ids + end)
        if rows := packer.take():
            yield _batch(rows, with_ids)
    packer.finish()
    if rows := packer.take():
        yield _batch(rows, with_ids)


def pack_documents(docs: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS,
                   tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence; with ``with_ids`` also its token ids (little-endian uint32).

    ``tiers`` are powers of two. doc_id, start (the document's ids before the piece), length, ids_crc32, doc_tokens (with the closing id), sequence_id, offset (in the sequence), window (its
    size) and step_group. Each id of each document is in exactly one piece. Null and empty texts
    consist of the closing id alone; texts of any length are tokenized whole; an empty table gives an empty result; repeated rows are documents of their own; a null doc_id stays null;
    other columns are not read. At most one sequence of each input split is not full.
    """
    if not tiers or any(w < 1 or w & (w - 1) for w in tiers):
        raise ValueError("tiers must be powers of two")
    path = tokenizer or tokenizer_path()
    return map_arrow(
        docs.select("doc_id", "text"), lambda batches: _pack(batches, path, tuple(tiers), step_tokens, with_ids), _DDL + (", ids BINARY" if with_ids else ""))
