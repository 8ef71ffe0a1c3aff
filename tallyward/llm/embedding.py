"""Embedding near-duplicates by cover trees and dual traversal.

Different vectors of one label are dealt to blocks of neighbours (nearest of a bounded set of pivots, the
tree's top level). Each block is a cover tree: nested levels of centres, each level's radius half of the one
above, each node with its measured covering radius. Two blocks meet only if the distance of their centres
does not exceed the threshold by more than their radii; a task then walks both trees at once, prunes
pairs of nodes by the same bound, level by level, and compares what is left exactly, in double precision.
A block is compared with itself in the same way, so the result is that of all pairs.

Pivots decide only where vectors lie, never what is compared. Blocks are bounded, so a label with a third
of all vectors is many blocks; links leave a task as counts and a forest, never as all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.components import connected_components, star_forest
from tallyward.llm.storage import map_arrow, written

THRESHOLD = 0.93
# Vectors of a block, about; a fuller cell is split by hash.
BLOCK = 768
# Pivots of one label, and of all labels together: what every task gets at most.
MOST_PIVOTS, ALL_PIVOTS = 256, 4096
_RADII = (1.0, 0.5, 0.25, 0.125)
# Rounding of distances near zero, where the square root of a rounding error is 1e-8.
_SLACK = 1e-7
_DENSE = 0.1
_PAIRS_AT_ONCE = 1 << 17

_BLOCK_SCHEMA = ("block BIGINT, cell BIGINT, label BIGINT, width INT, n INT, centre ARRAY<DOUBLE>, radius DOUBLE, ids BINARY, copies BINARY, "
                 "units BINARY, levels ARRAY<STRUCT<parent: BINARY, point: BINARY, radius: BINARY>>")


def cover_tree(units: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (parent node in the level above, centre point, covering radius); the last level is the points.

    On each level a node's points are covered greedily: the first point not yet covered becomes a centre
    and takes all uncovered points of its parent within the level's radius.
    """
    n = len(units)
    apart = np.sqrt(np.maximum(2.0 - 2.0 * (units @ units.T), 0.0))
    owner = np.zeros(n, np.int64)
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([apart[0].max()]))]
    for radius in _RADII:
        fresh = np.full(n, -1, np.int64)
        parents, centres = [], []
        for point in range(n):
            if fresh[point] < 0:
                taken = (fresh < 0) & (owner == owner[point]) & (apart[point] <= radius)
                taken[point] = True
                fresh[taken] = len(centres)
                parents.append(owner[point])
                centres.append(point)
        owner = fresh
        reach = np.zeros(len(centres))
        np.maximum.at(reach, owner, apart[np.array(centres)[owner], np.arange(n)])
        levels.append((np.array(parents), np.array(centres), reach))
    return [*levels, (owner, np.arange(n), np.zeros(n))]


def _children(parent: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(parent, kind="stable")
    return order, np.searchsorted(parent[order], np.arange(nodes + 1))


def _spread(a: np.ndarray, b: np.ndarray, tree_a, tree_b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs (a, b)."""
    (order_a, first_a), (order_b, first_b) = tree_a, tree_b
    count_a, count_b = first_a[a + 1] - first_a[a], first_b[b + 1] - first_b[b]
    total = count_a * count_b
    pair = np.repeat(np.arange(len(a)), total)
    place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return order_a[first_a[a][pair] + place // count_b[pair]], order_b[first_b[b][pair] + place % count_b[pair]]


def linked_pairs(units_a, levels_a, units_b, levels_b, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Points (i of a, j of b) with cosine at least ``threshold``, by walking both trees level by level."""
    reach = np.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth in range(1, len(levels_a)):
        (parent_a, point_a, radius_a), (parent_b, point_b, radius_b) = levels_a[depth], levels_b[depth]
        tree_a, tree_b = _children(parent_a, len(levels_a[depth - 1][0])), _children(parent_b, len(levels_b[depth - 1][0]))
        last = depth == len(levels_a) - 1
        size = ((tree_a[1][a + 1] - tree_a[1][a]) * (tree_b[1][b + 1] - tree_b[1][b])).sum()
        if size > _DENSE * len(parent_a) * len(parent_b) and len(a) * 4 > len(levels_a[depth - 1][0]):
            alive = np.zeros((len(levels_a[depth - 1][0]), len(levels_b[depth - 1][0])), bool)
            alive[a, b] = True
            cosine = units_a[point_a] @ units_b[point_b].T
            most = _SLACK + reach + radius_a[:, None] + radius_b[None, :]
            near = alive[parent_a[:, None], parent_b[None, :]] & (2.0 - 2.0 * cosine <= most * most)
            a, b = np.nonzero(near)
        else:
            kept_a, kept_b = [], []
            ends = np.cumsum((tree_a[1][a + 1] - tree_a[1][a]) * (tree_b[1][b + 1] - tree_b[1][b]))
            at = 0
            while at < len(a):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS_AT_ONCE, "right")))
                i, j = _spread(a[at:to], b[at:to], tree_a, tree_b)
                cosine = np.einsum("ij,ij->i", units_a[point_a[i]], units_b[point_b[j]])
                most = _SLACK + reach + radius_a[i] + radius_b[j]
                near = 2.0 - 2.0 * cosine <= most * most
                kept_a.append(i[near])
                kept_b.append(j[near])
                at = to
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (kept_a, kept_b))
        if last:
            exact = np.concatenate([np.empty(0, bool)] + [
                np.einsum("ij,ij->i", units_a[a[s:s + _PAIRS_AT_ONCE]], units_b[b[s:s + _PAIRS_AT_ONCE]]) >= threshold
                for s in range(0, len(a), _PAIRS_AT_ONCE)])
            a, b = a[exact], b[exact]
    return a, b


def _unit(vectors: np.ndarray) -> np.ndarray:
    # The largest component first: squares of very large or small numbers would overflow.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _cells(batches: Iterator[pa.RecordBatch], pivots) -> Iterator[pa.RecordBatch]:
    """Adds the nearest pivot of the label (0 if it has none)."""
    for batch in batches:
        labels, widths = batch.column("label").to_numpy(zero_copy_only=False), batch.column("width").to_numpy(zero_copy_only=False)
        cell = np.zeros(batch.num_rows, np.int64)
        for key in set(zip(labels.tolist(), widths.tolist())) & pivots.value.keys():
            rows = np.flatnonzero((labels == key[0]) & (widths == key[1]))
            flat = batch.column("embedding").take(pa.array(rows)).values.to_numpy(zero_copy_only=False)
            cell[rows] = np.argmax(_unit(flat.astype(np.float64).reshape(len(rows), -1)) @ pivots.value[key].T, axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])


def _build(table: pa.Table) -> pa.Table:
    """One block: its vectors in unit length, its tree, centre and radius."""
    units = _unit(np.stack(table.column("embedding").to_pylist()).astype(np.float64))
    order = np.argsort(table.column("vec_id").to_numpy())
    units = units[order]
    levels = cover_tree(units)
    pack = lambda values, kind: np.ascontiguousarray(values, kind).tobytes()
    row = {"block": table.column("block")[0].as_py(), "cell": table.column("cell")[0].as_py(), "label": table.column("label")[0].as_py(), "width": units.shape[1], "n": len(units),
           "centre": units[0].tolist(), "radius": float(levels[0][2][0]),
           "ids": pack(table.column("vec_id").to_numpy()[order], np.int64), "copies": pack(table.column("copies").to_numpy()[order], np.int64),
           "units": pack(units, np.float64),
           "levels": [{"parent": pack(p, np.int64), "point": pack(c, np.int64), "radius": pack(r, np.float64)} for p, c, r in levels]}
    return pa.Table.from_pylist([row], pa.schema([
        ("block", pa.int64()), ("cell", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("n", pa.int32()), ("centre", pa.list_(pa.float64())),
        ("radius", pa.float64()), ("ids", pa.binary()), ("copies", pa.binary()), ("units", pa.binary()),
        ("levels", pa.list_(pa.struct([("parent", pa.binary()), ("point", pa.binary()), ("radius", pa.binary())])))]))


def _side(row: dict, side: str):
    read = lambda name, kind: np.frombuffer(row[f"{name}_{side}"], kind)
    levels = [tuple(np.frombuffer(level[k], kind) for k, kind in (("parent", np.int64), ("point", np.int64), ("radius", np.float64)))
              for level in row[f"levels_{side}"]]
    return read("ids", np.int64), read("copies", np.int64), read("units", np.float64).reshape(-1, row["width"]), levels


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """For each vector with links between two blocks: the number of linked vectors, and its root in the forest of these links."""
    row = table.to_pylist()[0]
    ids_a, copies_a, units_a, levels_a = _side(row, "a")
    ids_b, copies_b, units_b, levels_b = _side(row, "b")
    i, j = linked_pairs(units_a, levels_a, units_b, levels_b, threshold)
    if row["block_a"] == row["block_b"]:
        i, j = i[i != j], j[i != j]
        counts = [(ids_a, np.bincount(i, copies_b[j], len(ids_a)))]
    else:
        counts = [(ids_a, np.bincount(i, copies_b[j], len(ids_a))), (ids_b, np.bincount(j, copies_a[i], len(ids_b)))]
    roots = dict(zip(*(x.tolist() for x in star_forest(ids_a[i], ids_b[j]))))
    found = [(x, k) for ids, n in counts for x, k in zip(ids.tolist(), n.astype(np.int64).tolist()) if k]
    return pa.table({"vec_id": pa.array([x for x, _ in found], pa.int64()), "links": pa.array([k for _, k in found], pa.int64()),
                     "root": pa.array([roots.get(x, x) for x, _ in found], pa.int64())})


def _pivots(nodes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Some vectors of each label with more than a block, by hash; at most ``ALL_PIVOTS`` in all reach the driver."""
    sizes = nodes.groupBy("label", "width").agg(F.count("*").alias("size")).where(F.col("size") > 2 * BLOCK)
    wanted = F.least(F.ceil(F.col("size") / BLOCK), F.lit(MOST_PIVOTS))
    place = (F.xxhash64("vec_id", F.lit(1)) / F.lit(float(1 << 64)) + 0.5) * F.col("size")
    some = (nodes.join(F.broadcast(sizes.orderBy(F.desc("size"), "label", "width").limit(ALL_PIVOTS)), ["label", "width"])
            .where(place < wanted).select("label", "width", "vec_id", "embedding", place.alias("place"))
            .orderBy("place", "vec_id").limit(ALL_PIVOTS))
    found: dict[tuple[int, int], list] = {}
    for row in sorted(some.collect(), key=lambda r: r.vec_id):
        found.setdefault((row.label, row.width), []).append(row.embedding)
    return {key: _unit(np.array(rows, np.float64)) for key, rows in found.items()}


def _blocks(nodes: DataFrame) -> DataFrame:
    pivots = nodes.sparkSession.sparkContext.broadcast(_pivots(nodes))
    celled = map_arrow(nodes, lambda batches: _cells(batches, pivots),
                              "label BIGINT, width INT, embedding ARRAY<DOUBLE>, vec_id BIGINT, copies BIGINT, cell BIGINT")
    celled = written(celled, "cells")
    sizes = celled.groupBy("label", "width", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("n_parts"))
    keyed = celled.join(sizes, ["label", "width", "cell"]).withColumn(
        "block", F.xxhash64("label", "width", "cell", F.pmod(F.xxhash64("vec_id"), "n_parts")))
    return keyed.select("block", "cell", "label", "embedding", "vec_id", "copies").groupBy("block").applyInArrow(
        lambda table: _build(table), _BLOCK_SCHEMA)


def able_to_link() -> Column:
    """Label and id are not null, all components are finite and not all are zero."""
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distance(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    return F.sqrt(F.greatest(2.0 - 2.0 * dot, F.lit(0.0)))


def _near_blocks(outline: DataFrame, threshold: float) -> DataFrame:
    """(block_a, block_b): the block pairs that the covering radii do not rule out, each once.

    The upper levels of the dual traversal: cells of a label first (at most ``MOST_PIVOTS``), then the blocks of each pair
    of cells that is left. So a label with very many blocks is spread over its pairs of cells.
    """
    reach = float(np.sqrt(2.0 - 2.0 * threshold)) + _SLACK
    key = ["label", "width", "cell"]
    middles = outline.groupBy(*key).agg(F.min_by("centre", "block").alias("middle"))
    cells = outline.join(middles, key).groupBy(*key).agg(
        F.first("middle").alias("middle"), F.max(_distance("middle", "centre") + F.col("radius")).alias("cell_radius"))
    side = lambda df, s, *names: df.select("label", "width", *[F.col(n).alias(f"{n}_{s}") for n in names])
    cell_pairs = (side(cells, "a", "cell", "middle", "cell_radius").join(side(cells, "b", "cell", "middle", "cell_radius"), ["label", "width"])
                  .where("cell_a <= cell_b").where(_distance("middle_a", "middle_b") <= reach + F.col("cell_radius_a") + F.col("cell_radius_b"))
                  .select("label", "width", "cell_a", "cell_b"))
    names = ("block", "cell", "centre", "radius")
    met = cell_pairs.join(side(outline, "a", *names), ["label", "width", "cell_a"]).join(side(outline, "b", *names), ["label", "width", "cell_b"])
    return (met.where("cell_a < cell_b or block_a <= block_b")
            .where(_distance("centre_a", "centre_b") <= reach + F.col("radius_a") + F.col("radius_b")).select("block_a", "block_b"))


def embedding_near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label and width link if their cosine is at least ``threshold`` (above 0). Null, empty, zero and
    non-finite vectors, and those with null label, link with nothing and are kept; so is one with a null id,
    whose component is null. Equal vectors are compared once and counted as often as they occur.
    Rows that repeat a vec_id repeat its result; if their vectors differ, the links of both add up.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    able = embeddings.where(able_to_link()).select(
        F.col("label").cast("long").alias("label"), F.size("embedding").alias("width"),
        F.col("embedding").cast("array<double>").alias("embedding"), "vec_id")
    nodes = written(able.groupBy("label", "width", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "vectors")
    blocks = written(_blocks(nodes), "blocks", rows_per_file=16)
    pairs = _near_blocks(blocks.select("block", "cell", "label", "width", "centre", "radius"), threshold)
    load = lambda side: blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in ("block", "ids", "copies", "units", "levels")], *(
        ["width"] if side == "a" else []))
    work = pairs.join(load("a"), "block_a").join(load("b"), "block_b")
    found = written(work.groupBy("block_a", "block_b").applyInArrow(
        lambda table: _compare(table, threshold), "vec_id BIGINT, links BIGINT, root BIGINT"), "found")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).toDF("vec_id", "component")
    counted = nodes.join(links, "vec_id", "left").join(named, "vec_id", "left").select(
        "label", "width", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    linked = able.join(counted, ["label", "width", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = embeddings.where(~able_to_link()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
