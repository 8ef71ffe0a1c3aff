"""Document quality by an NB-SVM over byte n-grams.

Indicators of the n-grams of a text are scaled by the log-count ratio of the two classes (naive Bayes) and
a linear hinge-loss model is fitted on them by dual coordinate descent. Punctuation runs, upper case,
table marks and words of the languages are all byte n-grams, so there is no word list and no
tokenizer; word pairs of a word with itself count as one n-gram each for how common they are. The fit takes a bounded sample of labelled rows (``ROWS_PER_CLASS``, by hash of the id); scoring
takes every whole text, where it lies, in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.llm.linear import dual_coordinate_descent, sigmoid
from tallyward.llm.storage import fold, free_name, map_arrow, steps

ROWS_PER_CLASS = 1000
HASHED = 1 << 16
# The share of word pairs that repeat the word: one indicator for each of these shares that is passed.
REPEATED_PAIRS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4)
WIDTH = HASHED + len(REPEATED_PAIRS)
# One such indicator stands for as much text as this many byte n-grams.
REPEAT_WEIGHT = 8.0
MOST_BYTES_IN_A_GRAM = 4
FOLDS, HELD_OUT = 3, 1
_BYTES_AT_ONCE = 1 << 20


def indicators(text: bytes) -> np.ndarray:
    """Sorted numbers of the n-grams that occur: hashed ones of 1 to 4 bytes, then those of repeated words."""
    seen = np.zeros(WIDTH, bool)
    for at in range(0, len(text), _BYTES_AT_ONCE):
        part = np.frombuffer(text, np.uint8, min(len(text) - at, _BYTES_AT_ONCE + MOST_BYTES_IN_A_GRAM - 1), at).astype(np.uint32)
        gram = np.zeros(len(part), np.uint32)
        for size in range(1, MOST_BYTES_IN_A_GRAM + 1):
            if len(part) < size:
                break
            gram = (gram[:len(part) - size + 1] << np.uint32(8)) | part[size - 1:]
            seen[((gram + np.uint32(size)) * np.uint32(2654435761)) >> np.uint32(16)] = True
    words = text.split()
    share = sum(map(eq, words, islice(words, 1, None))) / max(1, len(words) - 1)
    seen[HASHED:] = share > np.array(REPEATED_PAIRS)
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class NaiveBayesSvm:
    """``ratio``: log-count ratios; ``scaled``: hinge-loss weights times ratios. Without rows of both classes: 0.5 for all."""

    ratio: np.ndarray
    scaled: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray) -> NaiveBayesSvm:
        if len(set(labels.tolist())) < 2:
            return cls(np.zeros(WIDTH), np.zeros(WIDTH), 0.0)
        counts = {1: np.ones(WIDTH), 0: np.ones(WIDTH)}
        for row, label in zip(rows, labels.tolist()):
            counts[label][row] += 1
        ratio = np.log(counts[1] / ((labels == 1).sum() + 2)) - np.log(counts[0] / ((labels == 0).sum() + 2))
        ratio[HASHED:] *= REPEAT_WEIGHT
        scaled_rows = []
        for row in rows:
            values = ratio[row]
            scaled_rows.append((row, (values / max(np.sqrt(values @ values), 1e-12)).astype(np.float32)))
        weights, bias = dual_coordinate_descent(scaled_rows, np.where(labels == 1, 1.0, -1.0), WIDTH, cost=10.0, rounds=20)
        return cls(ratio, weights * ratio, bias)

    def margin(self, row: np.ndarray) -> float:
        values = self.ratio[row]
        return float(self.scaled[row].sum() / max(np.sqrt(values @ values), 1e-12) + self.bias)


def _indicator_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, values in steps(batches, "text"):
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([indicators(v) for v in values], pa.list_(pa.int32()))], ["label", "grams"])


def training_ids(labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, label) to learn from: ids outside the held-out fold, the first of each class in hash order.

    Null ids and labels other than 0 and 1 teach nothing, nor do ids whose rows disagree.
    """
    known = (labels.select("doc_id", F.col("quality").alias("label")).where("doc_id is not null and label in (0, 1)")
             .where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other"))
    first = [known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
             for label in (0, 1)]
    return first[0].unionAll(first[1]).select("doc_id", F.col("label").cast("int").alias("label"))


def fit_quality(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> NaiveBayesSvm:
    """The model; at most ``2 * rows_per_class`` rows of at most ``WIDTH`` numbers reach the driver."""
    sample = F.broadcast(training_ids(labels, rows_per_class))
    # Of several rows of an id the one with the least text teaches: the same fit whenever it is repeated.
    rows = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    found = map_arrow(rows, _indicator_rows, "label INT, grams ARRAY<INT>").toArrow()
    grams = [row.values.to_numpy(zero_copy_only=False) for row in found.column("grams").combine_chunks()] if len(found) else []
    order = sorted(range(len(grams)), key=lambda i: grams[i].tobytes())  # the same fit whatever the order of arrival
    return NaiveBayesSvm.fit([grams[i] for i in order], found.column("label").to_numpy()[order] if order else np.empty(0, int))


def _scores(batches: Iterator[pa.RecordBatch], model: Broadcast, text: str, name: str) -> Iterator[pa.RecordBatch]:
    for batch, values in steps(batches, text):
        scores = [sigmoid(2 * model.value.margin(indicators(value))) for value in values]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])


def with_quality(docs: DataFrame, model: NaiveBayesSvm, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with one more column, the score from 0 to 1; it sees nothing but the text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return map_arrow(docs, lambda batches: _scores(batches, sent, text, name), schema)


def score_quality(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text is the empty text, which has no n-grams and gets the score of the bias alone. A null doc_id
    is not held out (held_out false). Repeated rows give repeated results; labels without rows of both
    classes give 0.5 for all; an empty table gives an empty result.
    """
    model = fit_quality(docs, labels, rows_per_class)
    scored = with_quality(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """``docs`` without those predicted 0; their columns stay as they are."""
    name = free_name(docs.columns, "score")
    model = fit_quality(docs, labels, rows_per_class)
    return with_quality(docs, model, name).where(F.col(name) >= 0.5).drop(name)
