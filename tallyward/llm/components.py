"""Connected components of a link table, on Spark alone.

Alternating large-star and small-star steps: every node moves its links to the smallest node it
knows of, until each component is a star around its smallest node. Each round is two aggregates
and two joins on the node, so a node with a third of all links is combined before the shuffle and
split by adaptive execution in the joins. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.storage import written


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as the pairs (a, b) with one link per node, to the least node reachable."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a):]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[left], parent[right]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the least id reachable, itself included.

    Repeated links, both directions and links of a node to itself are allowed; links with a null
    end connect nothing. An empty table gives an empty result. Nodes without links do not appear.
    """
    known = edges.where("a is not null and b is not null")
    loops = known.where("a = b").select("a").distinct().select("a", F.col("a").alias("b"))
    current = written(
        known.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _signature(current)
    while before[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(current.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(lowest.select("a", "m")).distinct())
        current = written(small, "links")
        after = _signature(current)
        if after == before:
            break
        before = after
    roots = current.select("b").distinct().select("b", F.col("b").alias("m"))
    return current.select("a", "b").unionAll(roots).unionAll(loops).toDF("id", "component").groupBy("id").agg(
        F.min("component").alias("component"))
