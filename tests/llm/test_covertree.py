import numpy as np

from sitelens.llm import covertree as C
from tests.llm.conftest import union_find


def test_tree_covers_and_nests():
    rng = np.random.default_rng(1)
    points = np.concatenate((rng.normal(size=(300, 8)), np.ones((1, 8)) + 0.02 * rng.normal(size=(300, 8))))
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree = C.CoverTree(points)
    assert sorted(tree.order) == list(range(600))
    for node, (first, last) in enumerate(tree.kids):
        rows = tree.order[tree.begin[node]:tree.end[node]]
        far = np.linalg.norm(points[rows] - points[tree.centre[node]], axis=1).max()
        assert far <= tree.radius[node] + 1e-9 and tree.centre[node] in rows
        if last > first:
            assert tree.centre[node] in tree.centre[first:last]
            assert sum(tree.end[first:last] - tree.begin[first:last]) == len(rows)


def check(df, **kw):
    rows = df.collect()
    got = {r.vec_id: r for r in C.near_duplicates(df, **kw).collect()}
    assert len(got) == len(rows)

    def usable(v):
        return bool(v) and None not in v and np.isfinite(v).all() and any(v)

    unit = [np.array(r.embedding, float) / np.linalg.norm(r.embedding) if usable(r.embedding) else None for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None
             and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.9]
    ids = [r.vec_id for r in rows]
    comp = union_find(len(rows), pairs)
    least, links = {}, [0] * len(rows)
    for i, c in enumerate(comp):
        least[c] = min(least.get(c, ids[i]), ids[i])
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for i, r in enumerate(ids):
        g = got[r]
        assert (g.n_links, g.component_id, g.kept) == (links[i], least[comp[i]], r == least[comp[i]])
    return len(pairs)


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    rows = [(int(i), [float(x) for x in base[i % 6] + (0.05 + 0.1 * (i % 4)) * rng.normal(size=16)]) for i in range(300)]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=16)]) for i in range(200)]
    rows += [(2000 + i, rows[i % 3][1]) for i in range(30)]  # copies
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None] + [1.0] * 15),
             (3005, [float("inf")] * 16), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [1e-300, 2e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert check(df) > 1000
    assert check(df, block_rows=64) > 1000


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert C.near_duplicates(none).collect() == []
    some = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0])], none.schema)
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in C.near_duplicates(some).collect()) == [
        ("5", 2, 5), ("5", 2, 5), ("None", 2, 5)]
