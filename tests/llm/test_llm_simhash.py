"""SimHash near-duplicates against all pairs compared one by one."""

import itertools
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyward.llm.components import connected_components
from tallyward.llm.simhash import (
    drop_near_duplicates, fingerprint_links, simhash_components, simhash_near_duplicates)
from tallyward.llm.storage import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=3):
    """prints: (id, fingerprint) pairs; gives the least id of each one's component."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i][1] ^ prints[j][1]).count("1") <= distance:
            parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return [least.get(root(i)) for i in range(len(prints))]


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    expected = {(i, f"{f:016x}", c) for (i, f), c in zip(prints, components(prints))}
    assert {tuple(r) for r in simhash_near_duplicates(docs).collect()} == expected


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", None, None, 3), (None, "a b c d", None, None, 7),
            (5, "A b\tC d", None, None, 7), (5, "A b\tC d", None, None, 7), (7, "one", None, None, 3), (8, "two words", None, None, 9),
            (None, "alone here", None, None, 10), (9, "é" * 300_000 + " x y z", None, None, 300_006)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("simhash", F.lit("kept")).withColumn("component_id", F.lit(0))
    expected = [(r[0], plain_fingerprint(r[1])) for r in rows]
    got = simhash_near_duplicates(docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(
        repr((i, f"{f:016x}", c)) for (i, f), c in zip(expected, components(expected)))
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id is not None) == [
        (False, 1), (False, 5), (False, 7), (False, 8), (False, 9)]
    assert kept.where("doc_id is null").count() == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash_near_duplicates(empty).count() == 0
    assert drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("distance", [0, 2, 3])
def test_dense_cells_and_chains(spark, monkeypatch, distance):
    import random

    import tallyward.llm.simhash as module

    monkeypatch.setattr(module, "CELL_OWNERS", 8)
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1, 1 << 63]
    values = {s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (1 << 64) - 1 for s in seeds for _ in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    prints = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id long, simhash long")
    got = {r.simhash: r.component_id for r in simhash_components(prints, distance).collect()}
    expected = components([(i, v & (1 << 64) - 1) for i, v in enumerate(signed)], distance)
    assert [got[v] for v in signed] == expected


def test_no_more_links_than_members(spark):
    prints = spark.range(0, 1 << 10).select(F.col("id").alias("fp"))
    assert fingerprint_links(prints).count() <= 40 * (1 << 10)


def test_components_of_chains_loops_and_repeats(spark):
    edges = spark.createDataFrame(
        [(i, i + 1) for i in range(10, 60)] + [(5, 5), (3, 2), (2, 3), (70, 71), (71, 70), (None, 4), (60, 10)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {i: 10 for i in range(10, 61)} | {5: 5, 2: 2, 3: 2, 70: 70, 71: 70}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
