"""Clusters vs a union-find brute force; nearest-N on a far-away site."""

from pyspark.sql import functions as F

from sitelens.operators import nearest as nn
from sitelens.operators import patterns as pt
from sitelens.sources.sites import SITE_SCHEMA
from sitelens.sources.store_view import store_view
from tests.conftest import SF001


def _union_find(cells):
    parent = {c: c for c in cells}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c
    for (x, y) in cells:
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                o = (x + dx, y + dy)
                if o in parent:
                    a, b = find((x, y)), find(o)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
    groups = {}
    for c in cells:
        groups.setdefault(find(c), set()).add(c)
    return sorted(sorted(g) for g in groups.values())


def test_connected_cells_match_union_find(spark):
    # a snake, a diagonal chain, an isolated cell and a ring
    pts = [(0, i) for i in range(12)] + [(i, 11) for i in range(12)] + [(20 + i, i) for i in range(6)]
    pts += [(40, 40)] + [(50 + dx, 50 + dy) for dx in range(3) for dy in range(3) if (dx, dy) != (1, 1)]
    cells = spark.createDataFrame([(x, y, 1) for x, y in pts], "cx long, cy long, n long")
    got = {}
    for r in pt.connected_cells(cells).collect():
        got.setdefault(r["cluster"], set()).add((r["cx"], r["cy"]))
    assert sorted(sorted(g) for g in got.values()) == _union_find(set(pts))


def test_dense_clusters_cover_dense_cells(spark):
    s = store_view(spark, SF001)
    dense = pt.dense_cells(s, 0.005, 1.1).count()
    clusters = pt.dense_clusters(s, 0.005, 1.1)
    assert dense > 0 and clusters.agg(F.sum("n_cells")).first()[0] == dense


def test_nearest_far_site_gets_n_from_whole_table(spark):
    s = store_view(spark, SF001)
    far = spark.createDataFrame([(1, -33.9, 151.2, 1.0, None)], SITE_SCHEMA)  # far from every store
    out = nn.nearest_stores(far, s, n=3).orderBy("rank").collect()
    assert [r["rank"] for r in out] == [1, 2, 3]
    assert out[0]["distance_m"] <= out[1]["distance_m"] <= out[2]["distance_m"]
