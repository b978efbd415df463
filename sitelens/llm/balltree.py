"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Components become floor(256 x), so scores are integers and ties are exact.
Vectors are placed in shards of about ``SHARD_ROWS`` near each other (fewer rows
where that would give under ``MIN_SHARDS``): a bounded
sample gives pivots, each vector goes to its nearest pivot, and the rows of a
pivot are dealt by hash to as many shards as they need.  Every shard is a ball
(centre c, radius r); no vector in it scores above q.c + |q| r for a query q.

1. Queries meet the balls of all shards in blocks (equi-join on block numbers)
   and are searched first in the shard of the highest bound.  The k-th score
   found there is the query's current threshold.
2. Queries meet the balls again and go on, with that threshold, to the shards
   whose bound reaches it.

A task holds one shard and one block of queries.  It builds the ball tree,
walks it level by level dropping the nodes whose bound is below a query's
current k-th score, orders the remaining leaves of each query by bound and
visits them best first until the bounds fall below the k-th score, which rises
as leaves are scored.

Equal vectors: only the k + 1 with the smallest ids can be in a list, so the
others are left out beforehand (exact; a partial group limit before the
shuffle).  Equal queries are searched once, for k + 1 rows, and each drops its
own row.  Only the pivots, at most ``PIVOTS``, are broadcast by hand.

Defined results: vectors that are null or hold a null or non-finite component
take no part; vectors meet those of their own length only (empty ones score
0); an id is the query's own on its own row only, so another row with the same
id is a candidate; null ids are no queries and rank last among ties; scores
outside 64 bits are clamped in the result; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import bounded_sample, map_arrow, ship_package, stored

SHARD_ROWS, MIN_SHARDS = 32_768, 12
LEAF = 64
#: Pivots are at most this many, chosen from a sample of at most PIVOT_ROWS.
PIVOTS, PIVOT_ROWS = 1024, 8192
#: Shards that a query row meets at once, and queries of a task.
BALL_BLOCK, QUERY_BLOCK = 1024, 4096
LONG = (1 << 63) - 1


def pack(values: list[float]) -> bytes:
    """floor(256 x) / 256 of every component: single precision where that is exact, else double."""
    x = np.array(values, np.float64)
    with np.errstate(over="ignore"):
        x = np.where(np.abs(x) < 2.0 ** 44, np.floor(x * 256) / 256, x) + 0.0
        small = x.astype(np.float32)
    return small.tobytes() if (small == x).all() else x.tobytes()


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """Matrix of packed vectors, in units of 1/256."""
    out = np.empty((len(rows), dim))
    for k, row in enumerate(rows):
        out[k] = np.frombuffer(row, np.float32 if len(row) == 4 * dim else np.float64)
    return out


def fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every partial sum of integer inner products of their rows is exact in doubles."""
    most = [float(np.abs(m).max()) if m.size else 0.0 for m in (a, b)]
    with np.errstate(over="ignore"):
        return most[0] * most[1] * 65536.0 * max(1, a.shape[1]) < 2.0 ** 53


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two matrices in units of 1/256: doubles
    where those are exact, else Python integers, clamped to 64 bits."""
    if fits(a, b):
        return (a * 256.0) @ (b * 256.0).T

    def whole(row: np.ndarray) -> list[int]:
        return [int(x) * 256 if abs(x) >= 2.0 ** 44 else int(x * 256) for x in row.tolist()]

    left, right = [whole(r) for r in a], [whole(r) for r in b]
    out = np.empty((len(a), len(b)), object)
    for i, x in enumerate(left):
        out[i] = [max(-LONG - 1, min(LONG, sum(u * v for u, v in zip(x, y)))) for y in right]
    return out


def ball_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bound of the score of every query with a vector of every ball, widened against rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.linalg.norm(queries, axis=1)[:, None]
        reach = length * radii[None, :]
        slack = 1e-9 * (length * np.linalg.norm(centres, axis=1)[None, :] + reach) + 1e-9
        out = (queries @ centres.T + reach + slack) * 65536.0
    return np.where(np.isnan(out), np.inf, out)


def ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(centre, radius) that holds all points; not finite for vectors too long for doubles, which prunes nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        centre = points.mean(axis=0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9)
    return centre, radius


class Tree:
    """Ball tree over rows in tie order; nodes are kept by level, leaves last."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # parents, centres, radii
        self.leaves: list[np.ndarray] = []
        nodes = [(0, np.arange(len(points)))]
        depth = max(0, math.ceil(math.log2(max(1, len(points)) / LEAF)))
        for level in range(depth + 1):
            balls = [ball(points[rows]) for _, rows in nodes]
            self.levels.append((np.array([p for p, _ in nodes]), np.array([c for c, _ in balls]), np.array([r for _, r in balls])))
            if level == depth:
                self.leaves = [rows for _, rows in nodes]
            else:
                nodes = [(k, part) for k, (_, rows) in enumerate(nodes) for part in self.halves(rows) if len(part)]

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows split at the median along the line between two far points."""
        points = self.points[rows]
        with np.errstate(over="ignore", invalid="ignore"):
            one = points[np.argmax(((points - points[0]) ** 2).sum(axis=1))]
            two = points[np.argmax(((points - one) ** 2).sum(axis=1))]
            along = points @ (one - two)
        order = np.argsort(along, kind="stable")
        cut = len(rows) // 2
        return np.sort(rows[order[:cut]]), np.sort(rows[order[cut:]])

    def leaf_bounds(self, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Bound of every leaf for every query; -inf where a node above it stays below the query's floor."""
        alive = np.ones((len(queries), 1), bool)
        bounds = np.full((len(queries), 1), np.inf)
        for parents, centres, radii in self.levels:
            alive, above = alive[:, parents], bounds[:, parents]
            seen = np.flatnonzero(alive.any(axis=0))
            bounds = np.full((len(queries), len(parents)), -np.inf)
            bounds[:, seen] = np.minimum(ball_bounds(queries, centres[seen], radii[seen]), above[:, seen])
            alive = alive & (bounds >= floor[:, None])
        return np.where(alive, bounds, -np.inf)


def search(tree: Tree, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, rows) of the k best rows of every query scoring at least ``floor``, ties to the smaller row.

    Missing places hold row -1.
    """
    n, rows = len(queries), len(tree.points)
    exact = not fits(queries, tree.points)
    best = np.full((n, k), -np.inf, object if exact else np.float64)
    place = np.full((n, k), rows)
    bounds = tree.leaf_bounds(queries, floor)
    order = np.argsort(-bounds, axis=1, kind="stable")
    active, done, width = np.arange(n), 0, 1
    while len(active) and done < order.shape[1]:
        visit = order[active, done:done + width]
        value = np.take_along_axis(bounds[active], visit, axis=1)
        kth = np.maximum(floor[active], best[active, -1].astype(float))
        wanted = (value >= kth[:, None]) & (value > -np.inf)
        for leaf in np.unique(visit[wanted]):
            asking = active[((visit == leaf) & wanted).any(axis=1)]
            members = tree.leaves[leaf]
            found = np.concatenate([best[asking], scores(queries[asking], tree.points[members])], axis=1)
            where = np.concatenate([place[asking], np.broadcast_to(members, (len(asking), len(members)))], axis=1)
            if exact:
                top = np.array([sorted(range(found.shape[1]), key=lambda j: (-found[i, j], where[i, j]))[:k]
                                for i in range(len(asking))])
            else:
                top = np.lexsort((where, -found), axis=1)[:, :k]
            best[asking] = np.take_along_axis(found, top, axis=1)
            place[asking] = np.take_along_axis(where, top, axis=1)
        active = active[wanted[:, -1]]
        done += width
        width = min(2 * width, 16)
    missing = (place >= rows) | (best.astype(float) < floor[:, None])
    return best, np.where(missing, -1, place)


def _usable(column: Column) -> Column:
    return column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``row, id, dim, v`` of the usable vectors, written once so that row numbers last."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), x.alias("x")).filter(_usable(F.col("x"))) \
        .withColumn("row", F.monotonically_increasing_id())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("x")
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("id"), lists.value_lengths().cast(pa.int32()),
             pa.array([pack(v) for v in lists.to_pylist()], pa.binary())], ["row", "id", "dim", "v"])

    return stored(map_arrow(rows.select("row", "id", "x"), run, f"row long, id {_kind(rows)}, dim int, v binary"), "vectors")


def _kind(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def choose_pivots(rows: DataFrame, shard_rows: int, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """Pivots per vector length, one for about ``shard_rows`` vectors, at most PIVOTS in all."""
    out, left = {}, PIVOTS
    for dim, n in counts.items():
        want = min(left, math.ceil(n / shard_rows))
        if want < 2 or dim == 0:
            continue
        left -= want
        sample = bounded_sample(rows.filter(F.col("dim") == dim).select("v"), min(PIVOT_ROWS, 8 * want), ["v"])
        points = unpack(sorted(bytes(r[0]) for r in sample.collect()), dim)
        # Each next pivot is the sampled point farthest from the pivots so far.
        with np.errstate(over="ignore", invalid="ignore"):
            picked = [0]
            gap = np.linalg.norm(points - points[0], axis=1)
            while len(picked) < min(want, len(points)):
                picked.append(int(np.argmax(gap)))
                gap = np.minimum(gap, np.linalg.norm(points - points[picked[-1]], axis=1))
        out[dim] = points[picked]
    return out


def placed(rows: DataFrame, shard_rows: int, counts: dict[int, int]) -> DataFrame:
    """``shard, row, id, dim, v``: the shard is named by length, nearest pivot and part of that pivot's rows."""
    shared = rows.sparkSession.sparkContext.broadcast(choose_pivots(rows, shard_rows, counts))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = np.asarray(batch.column("dim"))
        data = batch.column("v").to_pylist()
        nearest = np.zeros(len(data), np.int32)
        for dim in np.unique(dims):
            centres = shared.value.get(int(dim))
            if centres is not None:
                at = np.flatnonzero(dims == dim)
                points = unpack([data[i] for i in at], int(dim))
                with np.errstate(over="ignore", invalid="ignore"):
                    far = (centres ** 2).sum(axis=1)[None, :] - 2 * points @ centres.T
                nearest[at] = np.argmin(np.where(np.isnan(far), np.inf, far), axis=1)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "id", "dim", "v")], pa.array(nearest)],
                                          ["row", "id", "dim", "v", "pivot"])

    near = stored(map_arrow(rows.select("row", "id", "dim", "v"), run, f"row long, id {_kind(rows)}, dim int, v binary, pivot int"), "near")
    parts = near.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).alias("parts"))
    # One row a pivot: at most PIVOTS and one a vector length beyond them.
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    return stored(near.join(parts, ["dim", "pivot"]).select(F.concat_ws(":", "dim", "pivot", part).alias("shard"), "row", "id", "dim", "v"),
                  "placed")


def balls(rows: DataFrame) -> DataFrame:
    """``shard, dim, centre, radius`` of every shard."""
    def run(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        centre, radius = ball(unpack(group.column("v").to_pylist(), dim))
        return pa.table({"shard": group.column("shard").slice(0, 1), "dim": pa.array([dim], pa.int32()),
                         "centre": [centre.tobytes()], "radius": [radius]})

    ship_package(rows.sparkSession)
    return stored(rows.select("shard", "dim", "v").groupBy("shard").applyInArrow(run, "shard string, dim int, centre binary, radius double"),
                  "balls")


def meet(asks: DataFrame, shards: DataFrame, n_asks: int, n_shards: int, first: bool) -> DataFrame:
    """``qid, shard, bound, floor, dim, v``: the shards whose bound reaches a query's floor.

    With ``first`` only the best shard of every query; else all but the one
    it was in (``asks`` has ``done``).  Blocks of queries meet blocks of balls.
    """
    across, down = math.ceil(n_shards / BALL_BLOCK), math.ceil(n_asks / QUERY_BLOCK)

    def run(queries: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("qid", "shard", "bound", "floor", "dim", "v")}
        if queries.num_rows and found.num_rows:
            ask_dims, ball_dims = (np.asarray(t.column("dim")) for t in (queries, found))
            names = np.array(found.column("shard").to_pylist(), object)
            vectors, centres = queries.column("v").to_pylist(), found.column("centre").to_pylist()
            qids, floors = np.asarray(queries.column("qid")), np.asarray(queries.column("floor"))
            done = np.array(queries.column("done").to_pylist(), object)
            radii = np.asarray(found.column("radius"))
            for dim in np.intersect1d(ask_dims, ball_dims):
                q, b = np.flatnonzero(ask_dims == dim), np.flatnonzero(ball_dims == dim)
                bounds = ball_bounds(unpack([vectors[i] for i in q], int(dim)),
                                     np.array([np.frombuffer(centres[j]) for j in b]).reshape(len(b), int(dim)), radii[b])
                if first:
                    i, j = np.arange(len(q)), bounds.argmax(axis=1)
                else:
                    i, j = np.nonzero((bounds >= floors[q][:, None]) & (names[b][None, :] != done[q][:, None]))
                out["qid"] += qids[q[i]].tolist()
                out["shard"] += names[b[j]].tolist()
                out["bound"] += bounds[i, j].tolist()
                out["floor"] += floors[q[i]].tolist()
                out["dim"] += [int(dim)] * len(i)
                out["v"] += [vectors[k] for k in q[i]]
        return pa.table(out, schema=pa.schema([("qid", pa.int64()), ("shard", pa.string()), ("bound", pa.float64()),
                                               ("floor", pa.float64()), ("dim", pa.int32()), ("v", pa.binary())]))

    left = asks.withColumn("down", F.pmod(F.xxhash64("qid"), F.lit(down))) \
        .withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = shards.withColumn("across", F.pmod(F.xxhash64("shard"), F.lit(across)).cast("int")) \
        .withColumn("down", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    out = left.groupBy("across", "down").cogroup(right.groupBy("across", "down")) \
        .applyInArrow(run, "qid long, shard string, bound double, floor double, dim int, v binary")
    if first:
        row = F.struct("bound", "shard", "floor", "dim", "v")
        out = out.groupBy("qid").agg(F.max(row).alias("r")).select("qid", "r.shard", "r.bound", "r.floor", "r.dim", "r.v")
    return out


def visit(pairs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``qid, score, id, row``: the best k rows of every pair of query and shard that reach the query's floor."""
    kind = _kind(rows)

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not shard.num_rows or not queries.num_rows:
            found = shard.slice(0, 0)
            return pa.table({"qid": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": found.column("id"), "row": found.column("row")})
        shard = shard.sort_by([("id", "ascending"), ("row", "ascending")])  # null ids come last
        dim = shard.column("dim")[0].as_py()
        tree = Tree(unpack(shard.column("v").to_pylist(), dim))
        best, place = search(tree, unpack(queries.column("v").to_pylist(), dim), np.asarray(queries.column("floor")), k)
        asked, rank = np.nonzero(place >= 0)
        at = pa.array(place[asked, rank])
        return pa.table({"qid": queries.column("qid").take(pa.array(asked)),
                         "score": pa.array([int(s) for s in best[asked, rank]], pa.int64()),
                         "id": shard.column("id").take(at), "row": shard.column("row").take(at)})

    # A shard that more than QUERY_BLOCK queries visit is copied for each block of them.
    blocks = pairs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).alias("blocks"))
    right = pairs.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks"))) \
        .select("shard", "block", "qid", "floor", "v")
    left = rows.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))) \
        .select("shard", "block", "row", "id", "dim", "v")
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")) \
        .applyInArrow(run, f"qid long, score long, id {kind}, row long")


def top_k(vectors: DataFrame, query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, <id_col>, score``: for every row that ``query`` (a condition on the column ``id``)
    selects, the ``k`` other rows of highest score, ties to the smaller id."""
    ship_package(vectors.sparkSession)
    all_rows = packed(vectors, id_col, vector_col)
    order = [F.asc_nulls_last("id"), F.asc("row")]
    copies = Window.partitionBy("dim", "v").orderBy(*order)
    rows = stored(all_rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"), "different")
    asking = all_rows.filter(F.coalesce(query, F.lit(False)))
    asks = stored(asking.select("dim", "v").distinct().withColumn("qid", F.monotonically_increasing_id()), "asks")
    n_asks = asks.count()
    counts = {r[0]: r[1] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(PIVOTS).collect()}
    own = asking.join(asks, ["dim", "v"]).select(F.col("qid"), F.col("id").alias("query_id"), F.col("row").alias("query_row"))
    if n_asks:
        size = max(LEAF, min(shard_rows, math.ceil(sum(counts.values()) / MIN_SHARDS)))
        shards = placed(rows, size, counts)
        found_balls = balls(shards)
        n_shards = found_balls.count()
        nowhere = asks.withColumn("floor", F.lit(float("-inf"))).withColumn("done", F.lit(None).cast("string"))
        start = stored(meet(nowhere, found_balls, n_asks, n_shards, first=True), "first-shard")
        found = stored(visit(start, shards, k + 1), "first-found")
        # The k + 1st score so far; fewer rows set no floor.
        kth = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")) \
            .select("qid", F.when(F.col("n") > k, F.col("least").cast("double")).alias("kth"))
        known = asks.join(start.select("qid", F.col("shard").alias("done")), "qid").join(kth, "qid", "left") \
            .withColumn("floor", F.coalesce("kth", F.lit(float("-inf")))).drop("kth")
        rest = stored(meet(known, found_balls, n_asks, n_shards, first=False), "other-shards")
        found = found.unionByName(visit(rest, shards, k + 1))
    else:
        found = rows.limit(0).select(F.lit(0).cast("long").alias("qid"), F.lit(0).cast("long").alias("score"), "id", "row")
    # A list is at most k + 1 rows a query vector; rows of one query vector share it.
    listed = found.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), *order))) \
        .filter(F.col("place") <= k + 1)
    others = own.join(listed, "qid").filter(F.col("row") != F.col("query_row"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("place"))
    return others.withColumn("rank", rank).filter(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
