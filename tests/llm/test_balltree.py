"""Exact top-k by ball trees against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import balltree as bt
from sitelens.llm.common import table
from tests.conftest import SF0001


def asks():
    return F.col("id") % 50 == 0



def brute(rows, k, asks=lambda i: i % 50 == 0):
    """(query_id, rank, id, score) over (id, vector) rows, every row a candidate of every other."""
    whole = [(i, None if v is None or any(x is None or not math.isfinite(x) for x in v)
              else [int(x) * 256 if abs(x) > 2 ** 44 else math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for a, (i, v) in enumerate(whole):
        if i is None or v is None or not asks(i):
            continue
        found = [(-max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(v, w)))), j is None, j or 0, j)
                 for b, (j, w) in enumerate(whole) if b != a and w is not None and len(w) == len(v)]
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_query_against_all_products(spark):
    vectors = table(spark, SF0001, "embeddings")
    got = [tuple(r) for r in bt.top_k(vectors, asks(), 5).collect()]
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()], 5)
    assert sorted(got) == sorted(want) and len(got) == 50


@pytest.mark.parametrize("sizes", [(64, 1024, 4096), (16, 2, 3)])
def test_clusters_copies_and_small_blocks(spark, monkeypatch, sizes):
    shard_rows, ball_block, query_block = sizes
    monkeypatch.setattr(bt, "BALL_BLOCK", ball_block)
    monkeypatch.setattr(bt, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(bt, "LEAF", 8)
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rnd.normal(scale=0.1, size=8)]) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(160)]  # a third of all rows are copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = [tuple(r) for r in bt.top_k(df, F.col("id") % 10 == 0, 4, shard_rows=shard_rows).collect()]
    assert sorted(got) == sorted(brute(rows, 4, lambda i: i % 10 == 0))


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (None, [1.0, 0.5]), (50, None), (100, [nan, 1.0]), (150, [inf, 1.0]),
            (200, [None, 1.0]), (250, []), (251, []), (300, [1.0, 2.0, 3.0]), (350, [1e300, -1e300]), (351, [2.0 ** 40, 3.7]),
            (400, [0.0, 0.0]), (7, [-0.001, 0.001]), (450, [2.0 ** 40, 2.0 ** 40 + 1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select(
        "*", *[F.lit("x").alias(c) for c in ("id", "row", "v", "dim", "shard", "qid", "score", "rank")])
    got = [tuple(r) for r in bt.top_k(df, asks(), 5).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 5), key=key)
    assert bt.top_k(df.limit(0), asks(), 5).collect() == []
    assert bt.top_k(df.filter("vec_id = 7"), asks(), 5).collect() == []
    assert bt.top_k(df.filter("vec_id = 300"), asks(), 5).collect() == []


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(3)
    points = np.concatenate([rnd.normal(c, 0.05, size=(200, 4)) for c in (-3, 0, 3)])
    tree = bt.Tree(points)
    queries = rnd.normal(2, 1, size=(20, 4))
    bounds = tree.leaf_bounds(queries, np.full(20, -np.inf))
    for k, rows in enumerate(tree.leaves):
        assert (bt.scores(queries, points[rows]) <= bounds[:, k:k + 1]).all()
    assert sorted(np.concatenate(tree.leaves)) == list(range(600))
    floor = np.sort(bt.scores(queries, points), axis=1)[:, -5]
    assert (tree.leaf_bounds(queries, floor) > -np.inf).mean() < 0.5
