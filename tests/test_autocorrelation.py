"""Moran statistics against the definition with a full weights matrix."""

import random

import numpy as np
import pytest

from sitelens.operators import autocorrelation as ac

SCHEMA = "id long, sector string, lat double, lng double"


def test_equals_the_weights_matrix(spark):
    rng = random.Random(2)
    spots = [(rng.choice(["a", "b", None]), rng.randrange(7), int(rng.triangular(0, 9, 1))) for _ in range(400)] + [("a", 50, 50)] * 3
    rows = [(i, s, 0.01 * y + 0.005, 0.01 * x - 0.035) for i, (s, x, y) in enumerate(spots)] + [(999, "a", None, 1.0)]
    stores = spark.createDataFrame(rows, SCHEMA)
    cells = sorted({(x - 4, y) for _, x, y in spots})
    w = np.array([[float(p != q and max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 1) for q in cells] for p in cells])

    def counts(sectors):
        return np.array([sum(s in sectors and (x - 4, y) == c for s, x, y in spots) for c in cells], float)

    got = {r.sector: r for r in ac.sector_moran(stores).collect()}
    assert set(got) == {"a", "b"}
    for sector, row in got.items():
        z = counts([sector]) - counts([sector]).mean()
        assert row.n_cells == len(cells) and row.n_stores == counts([sector]).sum()
        assert row.moran == pytest.approx(len(cells) / w.sum() * (z @ w @ z) / (z @ z), abs=2e-6)
    n = counts(["a", "b", None])
    z = n - n.mean()
    local = {(r.cx, r.cy): r for r in ac.local_moran(stores).collect()}
    assert set(local) == set(cells)
    for k, c in enumerate(cells):
        if w[k].any():
            assert local[c].local_moran == pytest.approx(z[k] * (w[k] @ z) / (z @ z / len(cells)), abs=2e-6)
            assert local[c].kind == ("H" if z[k] > 0 else "L") + ("H" if w[k] @ z > 0 else "L")
    assert local[(46, 50)].local_moran is None and local[(46, 50)].n_neighbours == 0


def test_no_spread_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ac.sector_moran(none).collect() == [] and ac.local_moran(none).collect() == []
    even = spark.createDataFrame([(i, "a", 0.005, 0.005 + 0.01 * i) for i in range(4)], SCHEMA)
    assert ac.sector_moran(even).first().moran is None and {r.kind for r in ac.local_moran(even).collect()} == {None}
