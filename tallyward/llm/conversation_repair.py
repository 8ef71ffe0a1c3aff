"""Structure repair of conversations: faults of their turns, and the cheapest edits to ``system? (user assistant)+``.

1. Turns become notes of some 60 bytes (digest, initial of the role, fault), equal ones with their number; a repeated turn
   is found by joining the first turn of each repeated text. No text is shuffled for it.
2. Notes are range-partitioned by conversation and turn, so a conversation with a third of all turns lies in many tasks, and
   cut into stretches of at most ``STRETCH`` rows. Different stretches share one Re-Pair grammar, whose rules are solved
   once each (``conversation_grammar``).
3. The stretches of a conversation are chained by their 4 x 4 matrices in one pass over sorted rows, which gives costs and audits.
4. Edits meet the texts again. Conversations of one stretch are sorted whole by hash of their id and their texts run past the audit. Longer
   ones meet theirs turn by turn, spread over stretches; only the digest of such a conversation, which is
   sequential by nature, runs through one task, and row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyward.llm.conversation_grammar import (
    CLOSING, EMPTY, Grammar, after, choose_end, next_role, re_pair)
from tallyward.llm.storage import BATCH_BYTES, map_arrow, ship, written

STRETCH = 1024
BLANKS = " \t\n\x0b\x0c\r"
# Audits of different sequences that one Python worker keeps.
KEPT_AUDITS = 100_000
_LEGAL = {"su", "ua", "au"}
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_ORDER = ("turn", "role", "digest")


def damage_conversations(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) damaged by crc32 of ``conv_id:turn``; nulls of any column read as one space.

    Remainder 0 of 20 drops a row (copies 0), 1 empties its text, 2 removes full stops, exclamation and question marks, 3
    repeats it (copies 2), 4 sets its role to user. A null turn stays null as a turn.
    """
    blank = F.lit(" ")
    name = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(name[2]).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(name[3], ".!?", "")).otherwise(name[3]).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def _notes(rows: DataFrame) -> DataFrame:
    """One row per different turn: conv_id, turn, role, digest, kind (0 blank, 1 cut off, 2 whole), copies, repeated."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    kind = F.when(bare == "", 0).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 2).otherwise(1)
    notes = (rows.select("conv_id", "turn", "role", _digest().alias("digest"), kind.alias("kind"), "copies")
             .groupBy("conv_id", *_ORDER, "kind").agg(F.sum("copies").alias("copies")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = (notes.where("copies > 0 and kind > 0").groupBy("conv_id", "role", "digest")
              .agg(F.min(place).alias("first"), F.count("*").alias("turns")).where("turns > 1")
              .select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return notes.join(firsts, same, "left").select(
        "conv_id", *_ORDER, "kind", "copies", F.coalesce(place > F.col("first"), F.lit(False)).alias("repeated"))


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _key() -> Column:
    """Tells the turns of a conversation apart; ``_key_of`` in Python."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lit(":"), F.col("role"), F.lit(":"),
                                  F.lower(F.hex(_digest()))).cast("binary")))


def _key_of(turn: int | None, role: str, digest: bytes) -> bytes:
    return hashlib.md5(f"{'' if turn is None else turn}:{role}:{digest.hex()}".encode()).digest()


class _Stretch:
    """Rows of one conversation that follow one another."""

    def __init__(self, conv_id, number: int):
        self.conv_id, self.number = conv_id, number
        self.letters: list[str] = []
        self.keys: list[bytes] = []
        self.first_turn = self.last_turn = None
        self.turns = self.illegal = 0
        self.first_initial = self.last_initial = None

    def add(self, letter: str, initial: str, turn: int | None, key: bytes | None) -> None:
        if self.last_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in _LEGAL:
            self.illegal += 1
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        self.letters.append(letter)
        if key is not None:
            self.keys.append(key)

    def row(self, part: int) -> tuple:
        letters = "".join(self.letters)
        return (self.conv_id, part, self.number, letters, self.first_turn, self.last_turn, self.turns, self.illegal,
                self.first_initial, self.last_initial, b"".join(self.keys))


_STRETCH_FIELDS = "part INT, number INT, letters STRING, first_turn LONG, last_turn LONG, turns LONG, illegal LONG, first_initial STRING, last_initial STRING, keys BINARY"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Batches of rows of together about a quarter of ``BATCH_BYTES``, as ``size`` of a row tells."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += 100 + size(row)
        if total > BATCH_BYTES // 4:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(column.to_pylist() for column in batch.columns)) for batch in batches)


def _stretched(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()

    def stretches() -> Iterator[tuple]:
        now = None
        for conv_id, turn, role, digest, kind, copies, repeated in _rows(batches):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now.row(part)
                now = _Stretch(conv_id, 0)
            initial = role[:1]
            for copy in range(copies):
                if len(now.letters) == most:
                    yield now.row(part)
                    now = _Stretch(conv_id, now.number + 1)
                if kind == 0 or repeated or copy:
                    now.add("d" if kind else "b", initial, turn, None)
                else:
                    letter = initial if initial in ("s", "u", "a") else "o"
                    now.add(letter.upper() if kind == 1 else letter, initial, turn, _key_of(turn, role, digest))
        if now is not None:
            yield now.row(part)

    return _batches(stretches(), schema, lambda row: len(row[3]) + len(row[10]))


def _solved(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            part = batch.slice(at, 5000)
            found = sent.value.solve(part.column("packed").to_pylist())
            matrices = np.concatenate([found.cost.reshape(-1, 16), found.rank.reshape(-1, 16).astype(np.int64)], axis=1).astype("<i8")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([row.tobytes() for row in matrices], pa.binary())], ["sequence", "packed", "matrix"])


def _chain(rows: list[tuple], grammar: Grammar, known: dict[str, tuple]) -> tuple[list[tuple[int, str]], int]:
    """(state before, audit) of each stretch, the last one with its closing inserts, and the cost. ``rows``: (packed, matrix)."""
    solved = [(at, packed, np.frombuffer(matrix, "<i8")) for at, (packed, matrix) in enumerate(rows) if packed]
    pieces = [(EMPTY, "")] * len(rows)
    if not solved:
        return pieces, 0
    if len(solved) == 1 and solved[0][1] in known:
        pieces[solved[0][0]], cost = known[solved[0][1]]
        return pieces, cost
    cost, rank, back = np.array([0, *[1 << 40] * 3]), np.zeros(4, np.int64), []
    for _, _, matrix in solved:
        totals, inner = cost[:, None] + matrix[:16].reshape(4, 4), matrix[16:].reshape(4, 4)
        taken = np.argmin(np.minimum(totals, 1 << 40) * 4 + rank[:, None], axis=0)
        cost = np.minimum(totals[taken, np.arange(4)], 1 << 40)
        keys = np.where(cost < 1 << 40, rank[taken] * 4 + inner[taken, np.arange(4)], 1 << 40)
        rank = np.argsort(np.argsort(keys, kind="stable"))
        back.append(taken)
    end, total = choose_end(cost.tolist(), rank.tolist())
    closing = CLOSING[end]
    for (at, packed, _), taken in zip(reversed(solved), reversed(back)):
        start = int(taken[end])
        pieces[at] = (start, grammar.path(packed, start, end) + closing)
        end, closing = start, ""
    if len(solved) == 1:
        if len(known) >= KEPT_AUDITS:
            known.clear()
        known[solved[0][1]] = (pieces[solved[0][0]], total)
    return pieces, total


_AUDIT_FIELDS = ("part INT, number INT, whole BOOLEAN, summary BOOLEAN, state INT, before LONG, audit STRING, letters STRING, keys BINARY, "
                 + ", ".join(f"{c} LONG" for c in _COUNTS))


def _audited(batches: Iterator[pa.RecordBatch], sent: Broadcast, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each conversation one summary row and, unless it is one stretch alone, one row per stretch."""
    grammar, known = sent.value, {}

    def finished(conv_id, rows: list[tuple]) -> Iterator[tuple]:
        pieces, cost = _chain([(row[11], row[12]) for row in rows], grammar, known)
        letters = [row[3] for row in rows]
        turns = sum(row[6] for row in rows)
        illegal = sum(row[7] for row in rows)
        last_turn = last_initial = None
        first = next((row[4] for row in rows if row[4] is not None), None)
        for row in rows:
            turns -= row[4] is not None and row[4] == last_turn
            illegal += row[8] is not None and last_initial is not None and last_initial + row[8] not in _LEGAL
            last_turn = row[5] if row[5] is not None else last_turn
            last_initial = row[9] if row[9] is not None else last_initial
        gaps = 0 if first is None else last_turn - first + 1 - turns
        counts = (gaps, sum(t.count("b") for t in letters), sum(t.count("d") for t in letters),
                  sum(c in "SUAO" for t in letters for c in t), illegal, cost)
        whole = len(rows) == 1
        yield (conv_id, -1, -1, whole, True, EMPTY, 0, "".join(p[1] for p in pieces), None, None, *counts)
        given = 0
        for row, (state, audit) in zip(rows, pieces) if not whole else ():
            yield (conv_id, row[1], row[2], False, False, state, given, audit, row[3], row[10], *[None] * len(counts))
            given += len(audit) - audit.count("D")

    def audits() -> Iterator[tuple]:
        held: list[tuple] = []
        for row in _rows(batches):
            if held and row[0] != held[0][0]:
                yield from finished(held[0][0], held)
                held = []
            held.append(row)
        if held:
            yield from finished(held[0][0], held)

    return _batches(audits(), schema, lambda row: len(row[7]) + len(row[9] or b""))


def audit_conversations(rows: DataFrame, stretch: int) -> DataFrame:
    """The written audits of ``rows`` (conv_id, turn, role, text, copies): see ``_audited``."""
    conv = rows.schema["conv_id"]
    stretch_schema = T.StructType([conv, *T.StructType.fromDDL(_STRETCH_FIELDS).fields])
    audit_schema = T.StructType([conv, *T.StructType.fromDDL(_AUDIT_FIELDS).fields])
    arrow_stretch, arrow_audit = to_arrow_schema(stretch_schema), to_arrow_schema(audit_schema)
    ordered = _notes(rows).repartitionByRange("conv_id", *_ORDER).sortWithinPartitions("conv_id", *_ORDER)
    stretches = written(map_arrow(ordered, lambda b: _stretched(b, arrow_stretch, stretch), stretch_schema), "stretches").withColumn(
        "sequence", F.translate("letters", "bd", "xx"))
    grammar, packed = re_pair(stretches.where("sequence <> ''").select("sequence").distinct(), "sequence")
    sent = rows.sparkSession.sparkContext.broadcast(grammar)
    solved = map_arrow(packed, lambda b: _solved(b, sent), "sequence STRING, packed STRING, matrix BINARY")
    joined = (stretches.join(solved, "sequence", "left").select(*stretch_schema.names, "packed", "matrix")
              .repartition("conv_id").sortWithinPartitions("conv_id", "part", "number"))
    return written(map_arrow(joined, lambda b: _audited(b, sent, arrow_audit), audit_schema), "audits")


class _Player:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, audit: str, state: int = EMPTY):
        self.audit, self.at, self.state = audit, 0, state

    def _give(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        self.state = after(self.state, role[:1])
        return edit, role, text

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._give("I", next_role(self.state), "")

    def edit(self) -> str:
        self.at += 1
        return self.audit[self.at - 1]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.edit()
        if edit != "D":
            yield self._give(edit, role if edit == "K" else next_role(self.state), text)


_TURN_FIELDS = "position LONG, edit STRING, role STRING, text STRING"


def _whole_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, counts or None, turn or None): each conversation's summary first, then its repaired turns."""
    player = conv_id = None
    for conv_id_, is_row, role, text, copies, audit, *counts in _rows(batches):
        if not is_row:
            if player is not None:
                yield from ((conv_id, None, turn) for turn in player.inserts())
            conv_id, player = conv_id_, _Player(audit)
            yield conv_id, (audit, *counts), None
            continue
        for _ in range(copies):
            yield from ((conv_id, None, turn) for turn in player.row(role, text))
    if player is not None:
        yield from ((conv_id, None, turn) for turn in player.inserts())


def _digested(turns: Iterator[tuple]) -> Iterator[tuple]:
    """One row per conversation: conv_id, counts, audit, digest of its turns."""
    now = digest = None
    for conv_id, summary, turn in turns:
        if summary is not None:
            if now is not None:
                yield (*now, digest.hexdigest())
            now, digest, first = (conv_id, *summary[1:], summary[0]), hashlib.sha256(), True
        else:
            digest.update(f"{'' if first else chr(10)}{turn[1]}:{turn[2]}".encode())
            first = False
    if now is not None:
        yield (*now, digest.hexdigest())


def _numbered(turns: Iterator[tuple]) -> Iterator[tuple]:
    position = 0
    for conv_id, summary, turn in turns:
        if summary is not None:
            position = 0
        else:
            yield conv_id, position, *turn
            position += 1


def _stretch_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Repaired turns of stretches: (conv_id, position, edit, role, text). Each stretch's audit comes first, then its turns by place."""
    player = None
    conv_id = position = None
    letter_at, letters = 0, ""

    def up_to(place: int) -> Iterator[tuple]:
        nonlocal letter_at
        while letter_at < place:  # rows without a text here are deleted ones
            yield from player.row("", "")
            letter_at += 1

    for conv_id_, is_row, place, role, text, audit, state, before, letters_ in _rows(batches):
        if not is_row:
            if player is not None:
                for turn in chain(up_to(len(letters)), player.inserts()):
                    yield conv_id, position, *turn
                    position += 1
            conv_id, player, position, letters, letter_at = conv_id_, _Player(audit, state), before, letters_, 0
            continue
        for turn in chain(up_to(place), player.row(role, text)):
            yield conv_id, position, *turn
            position += 1
        letter_at = place + 1
    if player is not None:
        for turn in chain(up_to(len(letters)), player.inserts()):
            yield conv_id, position, *turn
            position += 1


def _text_size(row: tuple) -> int:
    return len(row[-1] or "")


def _arrow(fields: list[T.StructField]) -> pa.Schema:
    return to_arrow_schema(T.StructType(fields))


def _short_inputs(rows: DataFrame, audits: DataFrame, long_ids: DataFrame) -> DataFrame:
    """Summaries of conversations of one stretch and their rows, sorted: is_row, role, text, copies, audit, counts."""
    kept = rows.where("copies > 0").join(long_ids, rows["conv_id"].eqNullSafe(long_ids["long_id"]), "left_anti")
    nothing = [F.lit(None).cast("string").alias("audit"), *(F.lit(None).cast("long").alias(c) for c in _COUNTS)]
    texts = kept.select("conv_id", F.lit(True).alias("is_row"), "turn", "role", _digest().alias("digest"), "text", F.col("copies").cast("int").alias("copies"), *nothing)
    heads = audits.where("whole").select(
        "conv_id", F.lit(False).alias("is_row"), *(F.lit(None).cast(t).alias(c) for c, t in (
            ("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"), ("copies", "int"))), "audit", *_COUNTS)
    return (texts.unionAll(heads).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *_ORDER)
            .select("conv_id", "is_row", "role", "text", "copies", "audit", *_COUNTS))


def _long_turns(rows: DataFrame, audits: DataFrame, long_ids: DataFrame) -> DataFrame:
    """Repaired turns of the conversations of several stretches, each stretch in one task."""
    conv = rows.schema["conv_id"]
    pieces = audits.where("not summary")
    places = F.filter(F.transform(F.sequence(F.lit(1), F.length("letters")), lambda i: F.when(
        ~F.col("letters").substr(i, F.lit(1)).isin("b", "d"), i - 1)), lambda p: p.isNotNull())
    keyed = (pieces.where("length(letters) > 0").select("conv_id", "part", "number", places.alias("places"), "keys")
             .select("conv_id", "part", "number", F.posexplode("places").alias("at", "place"), "keys")
             .select(F.col("conv_id").alias("_conv"), "part", "number", "place",
                     F.substring("keys", F.col("at") * 16 + 1, F.lit(16)).alias("_key")))
    mine = rows.where("copies > 0").join(long_ids, rows["conv_id"].eqNullSafe(long_ids["long_id"]), "left_semi")
    texts = mine.withColumn("key", _key()).groupBy("conv_id", "key").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    found = texts.join(keyed, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key"))).select(
        "conv_id", "part", "number", F.lit(True).alias("is_row"), "place", "role", "text",
        *(F.lit(None).cast(t).alias(c) for c, t in (("audit", "string"), ("state", "int"), ("before", "long"), ("letters", "string"))))
    heads = pieces.select("conv_id", "part", "number", F.lit(False).alias("is_row"),
                          *(F.lit(None).cast(t).alias(c) for c, t in (("place", "int"), ("role", "string"), ("text", "string"))),
                          "audit", "state", "before", "letters")
    ordered = (found.unionAll(heads).repartition("conv_id", "part", "number")
               .sortWithinPartitions("conv_id", "part", "number", "is_row", "place")
               .select("conv_id", "is_row", "place", "role", "text", "audit", "state", "before", "letters"))
    fields = [conv, *T.StructType.fromDDL(_TURN_FIELDS).fields]
    arrow = _arrow(fields)
    return map_arrow(ordered, lambda b: _batches(_stretch_turns(b), arrow, _text_size), T.StructType(fields))


def _prepared(rows: DataFrame, stretch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    ship(rows.sparkSession)
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    text = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *text, "copies")
    audits = audit_conversations(rows, stretch)
    long_ids = written(audits.where("summary and not whole").select(F.col("conv_id").alias("long_id")), "long-conversations")
    return rows, audits, long_ids


def repaired_turns(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The repaired conversations: conv_id, position, edit (K, R or I), role, text.

    ``conversations`` has conv_id, turn, role, text and, if rows are to count more or less than once, copies.
    """
    rows, audits, long_ids = _prepared(conversations, stretch)
    fields = [rows.schema["conv_id"], *T.StructType.fromDDL(_TURN_FIELDS).fields]
    arrow = _arrow(fields)
    short = map_arrow(_short_inputs(rows, audits, long_ids),
                      lambda b: _batches(_numbered(_whole_turns(b)), arrow, _text_size), T.StructType(fields))
    return short.unionAll(_long_turns(rows, audits, long_ids))


def repair_conversations(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The digest is that of the repaired ``role:text`` joined by line ends, in UTF-8. Null roles and texts read as one space; a
    null conv_id is a conversation of its own. Rows are taken by turn, nulls first, those of one turn by role and MD5 of the
    text; repeated rows are duplicates of the first. A conversation whose rows all have copies 0 has zeros, an empty audit and
    the digest of the empty text. Texts of any length are read whole; an empty table gives an empty result; other columns are not read.
    """
    rows, audits, long_ids = _prepared(conversations, stretch)
    conv = rows.schema["conv_id"]
    fields = [conv, *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    arrow, schema = _arrow(fields), T.StructType(fields)
    short = map_arrow(_short_inputs(rows, audits, long_ids),
                      lambda b: _batches(_digested(_whole_turns(b)), arrow, lambda row: len(row[-2])), schema)
    turns = _long_turns(rows, audits, long_ids).select("conv_id", "position", "role", "text", F.lit(None).cast("string").alias("audit"),
                                                       *(F.lit(None).cast("long").alias(c) for c in _COUNTS))
    heads = audits.where("summary and not whole").select("conv_id", F.lit(-1).cast("long").alias("position"), *(
        F.lit(None).cast("string").alias(c) for c in ("role", "text")), "audit", *_COUNTS)
    ordered = turns.unionAll(heads).repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ((conv_id, (audit, *counts) if position < 0 else None, ("", role, text))
                for conv_id, position, role, text, audit, *counts in _rows(batches))
        return _batches(_digested(read), arrow, lambda row: len(row[-2]))

    return short.unionAll(map_arrow(ordered, digested, schema))
