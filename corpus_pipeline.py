"""A corpus pipeline of the training-data operators: filter, deduplicate, decontaminate, redact, pack.

All stages read whole texts of any length; a null text counts as empty and stays null, other columns may hold nulls, and an
empty table gives an empty result. The first four keep the columns of their input, also extra ones whose names they use themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.decontaminate import drop_contaminated
from tallyward.llm.packing import pack_documents
from tallyward.llm.quality import keep_good
from tallyward.llm.secret_scan import redact_secrets
from tallyward.llm.simhash import drop_near_duplicates
from tallyward.llm.storage import ship, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the NB-SVM, learnt from ``labels``, rejects go; repeated rows go or stay together. A tie (0.5) stays, and so does
    everything if the labels do not hold both classes."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays: that of the smallest doc_id, one row of it if it repeats. Texts
    without words are near-duplicates of one another."""
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a ``benchmark`` item (all of a shorter one) go; an empty benchmark drops none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by ``<SECRET>``; all documents stay, and n_chars follows the text."""
    return redact_secrets(docs, F.col("source"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens, with their token ids; an empty text is its closing id alone."""
    return pack_documents(docs, with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it has written."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs


# Hashing, learning and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None
