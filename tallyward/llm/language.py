"""Language identification in two levels.

The family is predicted first, by one machine for each family against the rest; then one-versus-one linear support vector
machines tell the languages of that family apart. A code that no listed family has is a family alone and needs no further machine, so the
model grows with the languages, by ``4 * WIDTH`` bytes each, and not with their square. Features are the square roots of the shares of hashed letter n-grams (1 to 3 letters,
lower-cased, runs of other characters as one space) of the whole text. The fit takes a bounded sample of
labelled rows (about ``ROWS_PER_LANGUAGE``, by hash of the id, and ``MOST_ROWS`` in all) of the ``MOST_LANGUAGES`` most frequent values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.llm.linear import dual_coordinate_descent, sigmoid
from tallyward.llm.storage import fold, map_arrow, steps

ROWS_PER_LANGUAGE = 600
MOST_ROWS = 12_000
# Languages that are learnt at most: their counts are broadcast, and 128 KB of weights for each family reach every task.
MOST_LANGUAGES = 400
WIDTH = 1 << 15
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_LETTERS_AT_ONCE = 1 << 20

# Families of common languages by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "uralic": ["et", "fi", "hu"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_is_letter: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter; built once in each Python worker."""
    if not _is_letter:
        _is_letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _is_letter[0]


def letter_shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram numbers, square roots of their shares); empty for a text without letters."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return np.empty(0, np.int32), np.empty(0)
    kept = letter | np.r_[True, letter[:-1]]  # the first other character after a letter stands for its run
    points = np.where(letter, points, np.uint32(32))[kept]
    counts = np.zeros(WIDTH)
    for at in range(0, len(points), _LETTERS_AT_ONCE):
        part = points[at:at + _LETTERS_AT_ONCE + 2]
        gram = np.zeros(len(part), np.uint32)
        for size in range(1, 4):
            if len(part) < size:
                break
            gram = gram[:len(part) - size + 1] * np.uint32(0x01000193) + part[size - 1:] * np.uint32(size)
            fresh = gram[:_LETTERS_AT_ONCE]
            counts += np.bincount((fresh * np.uint32(2654435761)) >> np.uint32(17), minlength=WIDTH)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), np.sqrt(counts[found] / counts.sum())


class OneVersusOne:
    """A machine for each pair of classes; the class with most votes wins, margins break ties."""

    def __init__(self, rows: list, labels: list[str]):
        self.classes = sorted(set(labels))
        of = np.array(labels)
        self.pairs = []
        for a, b in combinations(range(len(self.classes)), 2):
            inside = np.flatnonzero((of == self.classes[a]) | (of == self.classes[b]))
            signs = np.where(of[inside] == self.classes[a], 1.0, -1.0)
            weights, bias = dual_coordinate_descent([rows[i] for i in inside], signs, WIDTH, cost=10.0)
            self.pairs.append((a, b, weights.astype(np.float32), bias))

    def predict(self, row: tuple[np.ndarray, np.ndarray]) -> tuple[str, float]:
        """The class and how sure its weakest duel was (1 if there is no other class)."""
        votes, sure = np.zeros(len(self.classes)), np.ones(len(self.classes))
        for a, b, weights, bias in self.pairs:
            chance = sigmoid(2 * (float(weights[row[0]] @ row[1]) + bias))
            votes[a if chance >= 0.5 else b] += 1
            sure[a], sure[b] = min(sure[a], chance), min(sure[b], 1 - chance)
        best = max(range(len(votes)), key=lambda i: (votes[i], sure[i]))
        return self.classes[best], float(sure[best])


class OneVersusRest:
    """A machine for each class against all others; the largest margin wins, of equal ones the first name."""

    def __init__(self, rows: list, labels: list[str]):
        self.classes = sorted(set(labels))
        of = np.array(labels)
        self.weights = np.zeros((WIDTH, len(self.classes)), np.float32)
        self.biases = np.zeros(len(self.classes))
        for number, name in enumerate(self.classes if len(self.classes) > 1 else []):
            weights, self.biases[number] = dual_coordinate_descent(rows, np.where(of == name, 1.0, -1.0), WIDTH, cost=10.0)
            self.weights[:, number] = weights

    def predict(self, row: tuple[np.ndarray, np.ndarray]) -> tuple[str, float]:
        """The class and how sure its machine is, at least one half (1 if there is no other class)."""
        if len(self.classes) == 1:
            return self.classes[0], 1.0
        margins = row[1] @ self.weights[row[0]] + self.biases
        best = int(np.argmax(margins))
        return self.classes[best], max(0.5, sigmoid(2 * float(margins[best])))


@dataclass
class LanguageModel:
    families: OneVersusRest
    languages: dict[str, OneVersusOne]

    @classmethod
    def fit(cls, rows: list, labels: list[str]) -> LanguageModel:
        family = [_FAMILY.get(label.lower(), label) for label in labels]
        inside = {f: [i for i, x in enumerate(family) if x == f] for f in set(family)}
        return cls(OneVersusRest(rows, family),
                   {f: OneVersusOne([rows[i] for i in at], [labels[i] for i in at]) for f, at in inside.items()})

    def nbytes(self) -> int:
        """Bytes of the weights, which are sent to every task."""
        return self.families.weights.nbytes + sum(pair[2].nbytes for machines in self.languages.values() for pair in machines.pairs)

    def predict(self, text: bytes) -> tuple[str, float]:
        row = letter_shares(text)
        if not len(row[0]) or not self.families.classes:
            return UNKNOWN, 0.0
        family, sure = self.families.predict(row)
        language, surer = self.languages[family].predict(row)
        return language, sure * surer


def _share_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, values in steps(batches, "text"):
        shares = [letter_shares(value) for value in values]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([s[0] for s in shares], pa.list_(pa.int32())),
             pa.array([s[1] for s in shares], pa.list_(pa.float64()))], ["lang", "grams", "shares"])


def fit_language(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, most_rows: int = MOST_ROWS) -> LanguageModel:
    """The model from rows outside the held-out fold; at most ``most_rows`` rows of at most ``WIDTH`` numbers reach the driver."""
    known = docs.select("doc_id", "lang").where("doc_id is not null and lang is not null").where(
        fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    # Counts are combined before the shuffle, and a bounded number of them is sent to the rows: a language with most of them is no group anywhere.
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = (known.join(F.broadcast(counts), "lang").where(place < rows_per_language / F.col("n")).select("doc_id", "lang").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(most_rows))
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"])
    found = map_arrow(rows.select("lang", "text"), _share_rows, "lang STRING, grams ARRAY<INT>, shares ARRAY<DOUBLE>").toArrow()
    if not len(found):
        return LanguageModel.fit([], [])
    grams, shares = ([row.values.to_numpy(zero_copy_only=False) for row in found.column(c).combine_chunks()] for c in ("grams", "shares"))
    labels = found.column("lang").to_pylist()
    order = sorted((i for i in range(len(labels)) if len(grams[i])), key=lambda i: (labels[i], grams[i].tobytes()))
    return LanguageModel.fit([(grams[i], shares[i]) for i in order], [labels[i] for i in order])


def _predictions(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch, values in steps(batches, "text"):
        found = [model.value.predict(value) for value in values]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            ["doc_id", "lang_pred", "score"])


def identify_language(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A null text, an empty one or one without letters is ``und`` with score 0, and so is everything if no
    row can be learnt from. A null doc_id is not held out. Rows with null lang teach nothing; repeated
    rows give repeated results. A prediction sees the text alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit_language(docs, rows_per_language))
    schema = T.StructType([docs.select("doc_id").schema["doc_id"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    found = map_arrow(docs.select("doc_id", "text"), lambda batches: _predictions(batches, sent), schema)
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
