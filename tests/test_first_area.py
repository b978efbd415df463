"""The smallest of many overlapping districts, without the pairs of stores and districts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators import first_area as fa
from sitelens.operators import polygons as pg
from tests.test_polygons import STORES, even_odd, polygon, ring, scatter

DISTRICT = "level string, area_id long, geojson string, lat double, lng double, radius_m double"


def _stack(n, seed=0):
    """``n`` different districts a level, each over most of the same town."""
    rnd = np.random.default_rng(seed)
    return {(level, i): [ring(12, 37.5 + 0.05 * rnd.uniform(-1, 1), 127.0 + 0.05 * rnd.uniform(-1, 1), 0.8, i + 1000 * at)]
            for at, level in enumerate(["si", "gu"]) for i in rnd.permutation(n).tolist()}


@pytest.mark.parametrize("most", [fa.MAX_ROWS, 40])
def test_smallest_of_many_overlapping(spark, monkeypatch, most):
    stores, lats, lngs = scatter(spark, 2000, (36.9, 38.1), (126.4, 127.6))
    shapes = _stack(60)
    rows = [(level, i, polygon(r), None, None, None) for (level, i), r in shapes.items()]
    rows += [("gu", -5, None, 37.0, 126.5, 9000.0), ("si", None, polygon([[[126.4, 36.9], [126.5, 36.9], [126.4, 37.0], [126.4, 36.9]]]), None, None, None),
             ("other", 1, polygon([[[127.5, 38.0], [127.6, 38.0], [127.6, 38.1], [127.5, 38.0]]]), None, None, None)]
    areas = spark.createDataFrame(rows, DISTRICT)
    pairs = pg.stores_in_areas(areas.withColumn("area_id", F.struct("level", "area_id")), stores.select("id", "lat", "lng")).collect()
    want = {}
    for r in pairs:
        got = want.setdefault(r.id, {"si": None, "gu": None})
        level, i = r.area_id
        if level in got and i is not None:
            got[level] = i if got[level] is None else min(got[level], i)
    made, once = [], pg.first_areas
    monkeypatch.setattr(pg, "first_areas", lambda *a: made.append(once(*a)) or made[-1])
    paths = {r.id: {"si": r.si, "gu": r.gu} for r in pg.district_paths(areas, stores, ["si", "gu"], most).collect()}
    assert paths == want
    brute = {}
    for (level, i), rings in shapes.items():
        for k in np.flatnonzero(even_odd(lats, lngs, rings)).tolist():
            brute[k, level] = min(i, brute.get((k, level), 1 << 30))
    assert all(paths[k][level] in (i, -5) for (k, level), i in brute.items()) and any(v["gu"] == -5 for v in paths.values())
    assert any(v == {"si": None, "gu": None} for v in paths.values())  # of a district without id, or of no level asked for
    if most == fa.MAX_ROWS:  # before: a row for every store and district over it
        assert made[0].count() <= 2000 * 6 < len(pairs) / 4


def test_few_districts_are_tested(spark):
    """300 districts one above the other, of different shapes: a store meets a few of them."""
    rings = [(i, [[[127.0 + i * 1e-7, 37.0], [127.3, 37.0 + i * 1e-7], [127.3, 37.3], [127.0, 37.3], [127.0 + i * 1e-7, 37.0]]]) for i in range(300)]
    areas = spark.createDataFrame([("si", i, polygon(r), None, None, None) for i, r in rings], DISTRICT)
    index = pg.area_cells(areas).withColumn("kind", F.lit(0)).withColumn("cell", fa.cell_number(F.col("level"), F.col("cx"), F.col("cy")))
    i = fa.Index(index.toArrow())
    rnd = np.random.default_rng(2)
    lat, lng = rnd.uniform(37.001, 37.299, 3000), rnd.uniform(127.001, 127.299, 3000)
    level = index.select("level").distinct().collect()
    assert len(level) == 1
    g = 360.0 / 2 ** level[0].level
    cell = ((level[0].level << fa.BITS) + np.floor((lng + 180.0 + pg.OFFSET) / g).astype(np.int64) << fa.BITS) + np.floor((lat + 90.0 + pg.OFFSET) / g).astype(np.int64)
    store, row, unsure = i.first_rows(cell, lat, lng)
    assert sorted(store) == list(range(3000)) and not unsure.any() and i.tested < 3 * 3000
    inside = {k: even_odd(lat, lng, r) for k, r in rings}
    ids = index.toArrow().column("area_id").to_numpy()[i.rows[row]]
    assert all(inside[k][s] for s, k in zip(store, ids)) and math.isclose(np.mean(ids == 0), 1.0, abs_tol=0.01)


def test_levels_of_ids_given_twice(spark):
    """Rows of one id count as one place, as often as the id comes; without an id or a place not at all."""
    square = polygon([[[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]])
    areas = spark.createDataFrame([("si", 1, square, None, None, None), ("si", 0, square, None, None, None)], DISTRICT)
    stores = spark.createDataFrame([(1, "A", 1.5, 1.5, None, None), (1, "A", None, None, None, None), (None, "A", 1.5, 1.5, None, None),
                                    (2, "A", 5.0, 5.0, None, None)], STORES)
    got = {(r.si, r.level): (r.n, r.n_open) for r in pg.district_levels(areas, stores, ["si"]).collect()}
    assert got == {(0, 0): (2, 2), (None, 1): (2, 2)}
