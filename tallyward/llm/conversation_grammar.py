"""Cheapest repairs of role and fault sequences, solved once for each rule of a grammar that all sequences share.

A row of a conversation is one letter: its role's initial, upper case when its text is cut off, ``x`` when it must go.
Repairing is a path through four states (what has been given out so far) and each letter a min-plus matrix over
them: insert turns if need be, then keep, rerole or delete the row. Re-Pair replaces frequent pairs by rules, and the
matrix of a rule is the product of those of its two sides, so that rules are solved bottom-up, each once.

An entry holds its cost, the state in the middle (a rope: the audit of a rule is that of its left side up to the middle
state and that of its right side from there) and its rank among the audits from the same state. Audits of
one sequence from one state hold as many edits of rows and end in one, so none begins another: the first difference decides
between them whatever follows. So ranks of a product follow from those of its sides, and no audit is written out to compare it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.storage import written

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
LETTERS = "suaoSUAOx"
# Inserts that close a conversation left in a state.
CLOSING = {EMPTY: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
# Rules that one round of Re-Pair makes at most, and rounds; a sequence is right whether or not more rules would shorten it.
RULES_A_ROUND = 64
ROUNDS = 8
_NEVER = 1 << 40
_FIRST_RULE = 0x4E00


def after(state: int, initial: str) -> int | None:
    """The state after a turn of that role, None where none may stand."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def next_role(state: int) -> str:
    return "assistant" if state == USER else "user"


def _letter_edits(letter: str, start: int) -> dict[int, tuple[int, str]]:
    """The cheapest audit, and of those the first, to each state that one letter can lead to."""
    best: dict[int, tuple[int, str]] = {}
    state, inserts = start, 0
    for inserts in range(4):
        cost = INSERT * inserts
        options = [(state, cost + DELETE, "D")]
        if letter != "x":
            extra = CUT_OFF if letter.isupper() else 0
            kept = after(state, letter.lower())
            options += [(kept, cost + extra, "K")] if kept is not None else []
            options.append((after(state, next_role(state)[0]), cost + extra + REROLE, "R"))
        for end, price, edit in options:
            best[end] = min(best.get(end, (_NEVER, "")), (price, "I" * inserts + edit))
        state = after(state, next_role(state)[0])
    return best


@dataclass
class Transfer:
    """Matrices of some sequences: ``cost`` and ``rank`` (n, from, to), ``middle`` for products of two."""

    cost: np.ndarray
    rank: np.ndarray
    middle: np.ndarray | None = None

    @staticmethod
    def ranks(keys: np.ndarray, cost: np.ndarray) -> np.ndarray:
        return np.argsort(np.argsort(np.where(cost < _NEVER, keys, _NEVER), axis=-1, kind="stable"), axis=-1).astype(np.int8)

    def times(self, other: Transfer) -> Transfer:
        """Min-plus product; of equal costs the audit that comes first, which the left sides' ranks decide."""
        total = np.minimum(self.cost[:, :, :, None] + other.cost[:, None, :, :], _NEVER)
        middle = np.argmin(total * 4 + self.rank[:, :, :, None], axis=2)
        cost = np.take_along_axis(total, middle[:, :, None, :], 2)[:, :, 0, :]
        left = np.take_along_axis(self.rank, middle, 2).astype(np.int64)
        right = other.rank[np.arange(len(middle))[:, None, None], middle, np.arange(4)]
        return Transfer(cost, self.ranks(left * 4 + right, cost), middle.astype(np.int8))

    def at(self, which: np.ndarray) -> Transfer:
        return Transfer(self.cost[which], self.rank[which])


@dataclass
class Grammar:
    """Rules symbol -> (left, right) in the order of their making, with the matrix of each symbol."""

    symbols: str = LETTERS
    sides: dict[str, tuple[str, str]] = field(default_factory=dict)
    transfer: Transfer = None
    edits: dict[tuple[str, int, int], str] = field(default_factory=dict)

    def __post_init__(self):
        if self.transfer is None:
            cost = np.full((len(LETTERS), 4, 4), _NEVER, np.int64)
            keys = np.zeros_like(cost)
            for number, letter in enumerate(LETTERS):
                for start in range(4):
                    found = _letter_edits(letter, start)
                    for place, (end, (price, audit)) in enumerate(sorted(found.items(), key=lambda e: e[1][1])):
                        cost[number, start, end], keys[number, start, end] = price, place
                        self.edits[letter, start, end] = audit
            self.transfer = Transfer(cost, Transfer.ranks(keys, cost))

    def numbers(self, text: str) -> np.ndarray:
        """Symbols by number: letters first, rules in order."""
        codes = np.frombuffer(text.encode("utf-16-le"), "<u2").astype(np.int64)
        small = np.array([LETTERS.find(chr(c)) for c in range(128)])
        return np.where(codes >= _FIRST_RULE, codes - _FIRST_RULE + len(LETTERS), small[np.minimum(codes, 127)])

    def add(self, pairs: list[tuple[str, str]]) -> list[str]:
        """A rule for each pair of known symbols; all their matrices at once."""
        made = [chr(_FIRST_RULE + len(self.sides) + at) for at in range(len(pairs))]
        left, right = (self.transfer.at(self.numbers("".join(side))) for side in zip(*pairs))
        new = left.times(right)
        self.sides |= dict(zip(made, pairs))
        self.symbols += "".join(made)
        middle = self.transfer.middle if self.transfer.middle is not None else np.zeros((len(LETTERS), 4, 4), np.int8)
        self.transfer = Transfer(*(np.concatenate(parts) for parts in (
            (self.transfer.cost, new.cost), (self.transfer.rank, new.rank), (middle, new.middle))))
        return made

    def solve(self, texts: list[str]) -> Transfer:
        """The matrix of each text (a sequence of symbols, none empty), all texts side by side."""
        rows = [self.numbers(text) for text in texts]
        lengths = np.array([len(row) for row in rows])
        result = self.transfer.at(np.array([row[0] for row in rows]))
        for place in range(1, int(lengths.max())):
            longer = np.flatnonzero(lengths > place)
            step = result.at(longer).times(self.transfer.at(np.array([rows[i][place] for i in longer])))
            result.cost[longer], result.rank[longer] = step.cost, step.rank
        return result

    def audit(self, symbol: str, start: int, end: int) -> str:
        """The rope of a symbol written out."""
        key = (symbol, start, end)
        if key not in self.edits:
            left, right = self.sides[symbol]
            middle = int(self.transfer.middle[self.symbols.index(symbol), start, end])
            self.edits[key] = self.audit(left, start, middle) + self.audit(right, middle, end)
        return self.edits[key]

    def path(self, text: str, start: int, end: int) -> str:
        """The audit of a text of symbols from one state to another."""
        back: list[list[int]] = []
        cost, rank = [_NEVER] * 4, [0] * 4
        cost[start] = 0
        for number in self.numbers(text).tolist():
            costs, ranks = self.transfer.cost[number].tolist(), self.transfer.rank[number].tolist()
            taken = [min(range(4), key=lambda k: (cost[k] + costs[k][j], rank[k])) for j in range(4)]
            totals = [min(cost[k] + costs[k][j], _NEVER) for j, k in enumerate(taken)]
            order = sorted(range(4), key=lambda j: (totals[j] >= _NEVER, rank[taken[j]], ranks[taken[j]][j]))
            cost, rank = totals, [order.index(j) for j in range(4)]
            back.append(taken)
        parts = []
        for symbol, taken in zip(reversed(text), reversed(back)):
            parts.append(self.audit(symbol, taken[end], end))
            end = taken[end]
        return "".join(reversed(parts))


def choose_end(cost: list[int], rank: list[int]) -> tuple[int, int]:
    """(state, cost with its closing inserts) of the cheapest, then first audit."""
    return min(((state, cost[state] + INSERT * len(closing)) for state, closing in CLOSING.items()), key=lambda e: (e[1], rank[e[0]]))


def _without_overlap(pairs: list[str]) -> list[tuple[str, str]]:
    """Of pairs, most frequent first, those of which no occurrence touches one of another."""
    chosen, lefts, rights = [], set(), set()
    for left, right in pairs:
        if left not in rights and right not in lefts and (left != right or (left not in lefts and right not in rights)):
            chosen.append((left, right))
            lefts.add(left)
            rights.add(right)
    return chosen


def re_pair(sequences: DataFrame, name: str) -> tuple[Grammar, DataFrame]:
    """A grammar for the different sequences of letters in column ``name``, and the sequences with column ``packed``.

    Each round counts the pairs of neighbours in all sequences on Spark and makes rules of the frequent ones, at most
    ``RULES_A_ROUND``, until no pair occurs twice or ``ROUNDS`` are done; only these pairs reach the driver. Sequences are those
    of stretches, so a long conversation is many of them; an empty table gives the letters alone.
    """
    grammar = Grammar()
    packed = written(sequences.withColumn("packed", F.col(name)), "sequences")
    length = F.length("packed")
    neighbours = F.transform(F.sequence(F.lit(1), length - 1), lambda i: F.col("packed").substr(i, F.lit(2)))
    for _ in range(ROUNDS):
        counted = (packed.where(length > 1).select(F.explode(neighbours).alias("pair")).groupBy("pair").count()
                   .where("count > 1").orderBy(F.desc("count"), "pair").limit(RULES_A_ROUND))
        pairs = _without_overlap([row.pair for row in counted.collect()])
        if not pairs:
            break
        shorter: Column = F.col("packed")
        for (left, right), symbol in zip(pairs, grammar.add(pairs)):
            shorter = F.replace(shorter, F.lit(left + right), F.lit(symbol))
        packed = written(packed.withColumn("packed", shorter), "sequences")
    return grammar, packed
