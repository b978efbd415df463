"""Embedding near-dedup by dual traversal of cover trees: exact cosine threshold pairs.

Vectors are scaled to length one in double precision; cosine >= c is then
distance <= sqrt(2 - 2 c).  Equal vectors are one node with a count.  The top
level of the tree is distributed: pivots from a bounded sample, every node
under its nearest pivot, a pivot's nodes cut into blocks of at most
``BLOCK_ROWS``, each with its covering radius; pairs of blocks farther apart
than both radii and the threshold are pruned.  A task takes one pair of
blocks, builds a cover tree for each (nested centres, radii halving from 2,
true covering radii kept) and walks both trees together: a pair of tree nodes
is dropped when the distance of the centres exceeds both radii plus the
threshold and split otherwise, down to points, which are compared exactly.

In high dimensions without cluster structure no metric bound prunes the top
levels and nodes have about as many children as points; the walk then is a
blocked comparison of points, which is the best an exact method does there.  Only block descriptions (one per
``BLOCK_ROWS`` vectors) reach the driver; links stay distributed, each task
sends counts and a spanning forest instead of all pairs.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component link with nothing (0 links, own component); vectors of
different length do not link; equal vectors link with each other; a component
is named by its smallest non-null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import bounded_sample, checkpoint, map_arrow, ship_package
from sitelens.operators.components import components

BLOCK_ROWS = 8192
MIN_BLOCKS, MAX_PIVOTS = 6, 1024
LEAF = 64
#: Distances of the walk are single precision; this margin keeps the pruning safe.
MARGIN = 2e-3


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, v): v holds the scaled vector's doubles as bytes, null for a vector that links with nothing."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, dims = [], []
        for vec in batch.column("v").to_pylist():
            scaled = None
            if vec and None not in vec:
                x = np.array(vec, np.float64)
                if np.isfinite(x).all():
                    top = np.abs(x).max()
                    if top > 0:
                        x = x / top
                        scaled = x / math.sqrt(float(x @ x)) + 0.0  # no negative zeros
            out.append(None if scaled is None else scaled.tobytes())
            dims.append(0 if scaled is None else len(scaled))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
                                          ["id", "dim", "v"])

    picked = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = picked.schema["id"].dataType.simpleString()
    return map_arrow(picked, run, f"id {kind}, dim int, v binary")


class CoverTree:
    """Cover tree of unit vectors: nodes as arrays, every node's points contiguous in ``order``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.single = points.astype(np.float32)
        self.order = np.arange(len(points))
        self.centre, self.radius, self.begin, self.end, self.kids = [0], [0.0], [0], [len(points)], [(0, 0)]
        self.radius[0] = self._far(0, self.order)
        level = [(0, 1.0)]
        while level:
            nxt = []
            for node, radius in level:
                if self.end[node] - self.begin[node] > LEAF and self.radius[node] > 0:
                    nxt += [(child, radius / 2) for child in self._split(node, radius)]
            level = nxt
        self.centre, self.begin, self.end = map(np.array, (self.centre, self.begin, self.end))
        self.radius = np.array(self.radius, np.float32)

    def _far(self, centre: int, rows: np.ndarray) -> float:
        dots = self.single[rows] @ self.single[centre]
        return float(np.sqrt(max(0.0, 2 - 2 * float(dots.min())))) + MARGIN if len(rows) > 1 else 0.0

    def _split(self, node: int, radius: float) -> range:
        """Children of a node: centres more than ``radius`` apart (the node's own first) that cover its points."""
        rows = self.order[self.begin[node]:self.end[node]]
        rows = np.concatenate(([self.centre[node]], rows[rows != self.centre[node]]))
        near = 1 - radius * radius / 2  # as a dot product
        owner = np.full(len(rows), -1)
        centres: list[int] = []
        todo = np.arange(len(rows))
        while len(todo):
            some = todo[:256]
            dots = self.single[rows[some]] @ self.single[rows[some]].T
            fresh: list[int] = []
            for i in range(len(some)):
                if not fresh or dots[i, fresh].max() < near:
                    fresh.append(i)
            dots = self.single[rows[todo]] @ self.single[rows[some[fresh]]].T
            best = dots.argmax(axis=1)
            hit = dots[np.arange(len(todo)), best] >= near
            hit[np.searchsorted(todo, some[fresh])] = True
            best[np.searchsorted(todo, some[fresh])] = np.arange(len(fresh))
            owner[todo[hit]] = best[hit] + len(centres)
            centres += rows[some[fresh]].tolist()
            todo = todo[~hit]
        by = np.argsort(owner, kind="stable")
        self.order[self.begin[node]:self.end[node]] = rows[by]
        bounds = np.searchsorted(owner[by], np.arange(len(centres) + 1)) + self.begin[node]
        first = len(self.centre)
        for k, c in enumerate(centres):
            self.centre.append(c)
            self.begin.append(int(bounds[k]))
            self.end.append(int(bounds[k + 1]))
            self.kids.append((0, 0))
            self.radius.append(self._far(c, self.order[bounds[k]:bounds[k + 1]]))
        self.kids[node] = (first, first + len(centres))
        return range(first, first + len(centres))


def linked(a: CoverTree, b: CoverTree, rows: np.ndarray, cols: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs among points ``rows`` of ``a`` and ``cols`` of ``b``: a
    single-precision product picks the pairs, double precision decides."""
    for k in range(0, len(rows), 1024):
        part = rows[k:k + 1024]
        i, j = np.nonzero(a.single[part] @ b.single[cols].T >= cosine - MARGIN)
        for s in range(0, len(i), 100_000):
            p, q = part[i[s:s + 100_000]], cols[j[s:s + 100_000]]
            good = np.einsum("ij,ij->i", a.points[p], b.points[q]) >= cosine
            if good.any():
                yield p[good], q[good]


def walk(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All linked pairs of points (rows of ``a``, rows of ``b``) by a dual traversal.

    Where the children of two nodes are about as many as their points, testing
    children costs as much as testing points; the walk then compares the points.
    """
    reach = math.sqrt(2 - 2 * cosine)
    stack = [(0, 0)]
    while stack:
        x, y = stack.pop()
        kx, ky = a.kids[x], b.kids[y]
        rows, cols = a.order[a.begin[x]:a.end[x]], b.order[b.begin[y]:b.end[y]]
        tests = max(1, kx[1] - kx[0]) * max(1, ky[1] - ky[0])
        if kx == (0, 0) and ky == (0, 0) or a.radius[x] + b.radius[y] <= reach / 2 or 8 * tests >= len(rows) * len(cols):
            yield from linked(a, b, rows, cols, cosine)
            continue
        left = np.arange(*kx) if kx != (0, 0) else np.array([x])
        right = np.arange(*ky) if ky != (0, 0) else np.array([y])
        for k in range(0, len(left), 1024):
            part = left[k:k + 1024]
            dots = a.single[a.centre[part]] @ b.single[b.centre[right]].T
            apart = np.sqrt(np.maximum(2 - 2 * dots, 0))
            keep = apart <= a.radius[part][:, None] + b.radius[right][None, :] + (reach + MARGIN)
            i, j = np.nonzero(keep)
            one = (a.end[part[i]] - a.begin[part[i]] == 1) & (b.end[right[j]] - b.begin[right[j]] == 1)
            p, q = a.centre[part[i[one]]], b.centre[right[j[one]]]
            if len(p):
                good = np.einsum("ij,ij->i", a.points[p], b.points[q]) >= cosine
                yield p[good], q[good]
            stack += zip(part[i[~one]].tolist(), right[j[~one]].tolist())


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row connected with each of n rows by the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_blocks(table: pa.Table, cosine: float) -> pa.Table:
    """Links between the two blocks of a pair (or inside one): (node, n, root) for the nodes that have any."""
    side = table.column("side").to_numpy()
    count = table.column("n").to_numpy()
    points = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(table.num_rows, -1)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    tree = CoverTree(points[left])
    other = CoverTree(points[right]) if len(right) else tree
    n_links = np.zeros(table.num_rows, np.int64)
    label = np.arange(table.num_rows)
    for p, q in walk(tree, other, cosine):
        i, j = left[p], (right if len(right) else left)[q]
        if not len(right):
            i, j = i[i != j], j[i != j]
        n_links += np.bincount(i, count[j], len(n_links)).astype(np.int64)
        if len(right):
            n_links += np.bincount(j, count[i], len(n_links)).astype(np.int64)
        fresh = label[i] != label[j]
        if fresh.any():
            label = labels(len(label), np.concatenate((i[fresh], np.arange(len(label)))), np.concatenate((j[fresh], label)))
    rows = np.flatnonzero(n_links > 0)
    node = table.column("node")
    return pa.table({"node": node.take(pa.array(rows)), "n": pa.array(n_links[rows]), "root": node.take(pa.array(label[rows]))})


def near_pairs(nodes: DataFrame, cosine: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, n, root) partial results over all pairs of blocks; ``nodes`` has node, dim, v, n."""
    spark = nodes.sparkSession
    total = nodes.count()
    per_block = max(LEAF, min(block_rows, math.ceil(total / MIN_BLOCKS)))
    sample = bounded_sample(nodes, min(MAX_PIVOTS, max(1, total // per_block)), ["node"])
    pivots: dict[int, np.ndarray] = {}
    for dim in {r.dim for r in nodes.select("dim").distinct().limit(10_000).collect()}:
        rows = [np.frombuffer(r.v) for r in sample.filter(F.col("dim") == dim).orderBy("node").limit(MAX_PIVOTS).collect()]
        pivots[dim] = np.array(rows) if rows else np.eye(1, dim)
    shared = spark.sparkContext.broadcast(pivots)

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
        dims = batch.column("dim").to_numpy()
        vectors = batch.column("v").to_pylist()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            dots = np.frombuffer(b"".join(vectors[i] for i in at), np.float64).reshape(len(at), -1) @ shared.value[int(dim)].T
            cell[at] = dots.argmax(axis=1)
            far[at] = np.sqrt(np.maximum(2 - 2 * dots.max(axis=1), 0))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)],
                                          [*batch.schema.names, "cell", "far"])

    routed = checkpoint(map_arrow(nodes.select("node", "dim", "v", "n"), route,
                                  "node string, dim int, v binary, n long, cell int, far double"))
    blocks: list[tuple[int, int, int, int]] = []  # dim, cell, part, parts
    radius: list[float] = []
    for r in routed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("far")) \
            .orderBy("dim", "cell").collect():
        parts = math.ceil(r["rows"] / per_block)
        blocks += [(r.dim, r.cell, p, parts) for p in range(parts)]
        radius += [r.far] * parts
    reach = math.sqrt(2 - 2 * cosine) + MARGIN
    pairs = []
    for x, (dim, cell, part, _) in enumerate(blocks):
        for y in range(x, len(blocks)):
            if blocks[y][0] != dim:
                break
            gap = float(np.linalg.norm(pivots[dim][cell] - pivots[dim][blocks[y][1]]))
            if x == y or gap <= radius[x] + radius[y] + reach:
                pairs.append((len(pairs), x, 0))
                if x != y:
                    pairs.append((pairs[-1][0], y, 1))
    schema = "node string, n long, root string"
    if not pairs:
        return spark.createDataFrame([], schema)
    sides = spark.createDataFrame(pairs, "pair int, block int, side int")
    names = spark.createDataFrame([(k, *b) for k, b in enumerate(blocks)], "block int, dim int, cell int, part int, parts int")
    placed = routed.join(F.broadcast(names), ["dim", "cell"]) \
        .filter(F.pmod(F.xxhash64("node"), F.col("parts")) == F.col("part")).select("node", "v", "n", "block")
    ship_package(spark)
    return placed.join(F.broadcast(sides), "block").select("pair", "side", "node", "v", "n") \
        .groupBy("pair").applyInArrow(lambda t: compare_blocks(t, cosine), schema)


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    vectors = checkpoint(unit_vectors(rows, id_col, vec_col).withColumn("node", F.md5("v")))
    nodes = vectors.filter("node is not null").groupBy("node") \
        .agg(F.first("dim").alias("dim"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    found = checkpoint(near_pairs(nodes, cosine, block_rows))
    links = found.groupBy("node").agg(F.sum("n").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    own = vectors.select("id", "node")
    sizes = own.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    sizes = sizes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = sizes.groupBy("root").agg(F.min("least").alias("component"))
    per_node = sizes.join(named, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component")
    return own.join(per_node, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"))
