"""Areas of any shape against a plain even-odd test of every store and edge."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators import polygons as pg

STORES = "id long, sector string, lat double, lng double, open_date date, close_date date"


def scatter(spark, n, lat, lng, seed=1):
    rnd = np.random.default_rng(seed)
    lats, lngs = rnd.uniform(*lat, n), rnd.uniform(*lng, n)
    rows = [(i, "ABC"[i % 3], float(a), float((b + 180) % 360 - 180), None, None) for i, (a, b) in enumerate(zip(lats, lngs))]
    return spark.createDataFrame(rows, STORES), lats, lngs


def ring(n, lat, lng, r, seed):
    """A star-shaped ring of n points, closed as GeoJSON wants it; longitudes may pass 180."""
    rnd = np.random.default_rng(seed)
    at = np.sort(rnd.uniform(0, 2 * math.pi, n))
    far = r * rnd.uniform(0.4, 1.0, n)
    points = [[float(lng + f * math.cos(a)), float(lat + f * math.sin(a))] for a, f in zip(at, far)]
    return points + points[:1]


def wrapped(rings):
    return [[[(x + 180) % 360 - 180 if abs(x) > 180 else x, y] for x, y in r] for r in rings]


def even_odd(lats, lngs, rings):
    inside = np.zeros(len(lats), bool)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if ay != by:
                over = (ay > lats) != (by > lats)
                inside ^= over & (lngs < (bx - ax) * (lats - ay) / (by - ay) + ax)
    return inside


def polygon(rings):
    return json.dumps({"type": "Polygon", "coordinates": wrapped(rings)})


def areas_df(spark, rows):
    return spark.createDataFrame([(i, g, None, None, None) for i, g in rows],
                                 "area_id long, geojson string, lat double, lng double, radius_m double")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.area_id, []).append(r.id)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("centre", [(37.5, 127.0), (0.0, 0.0), (-20.0, 180.0), (65.0, -179.9)])
@pytest.mark.parametrize("rows", [pg.MAX_BROADCAST_ROWS, 0])
def test_rings_holes_and_parts(spark, centre, rows):
    lat, lng = centre
    stores, lats, lngs = scatter(spark, 3000, (lat - 1, lat + 1), (lng - 1, lng + 1))
    shapes = {i: [ring(5 + 7 * i, lat + 0.1 * i, lng - 0.1 * i, 0.9, i)] for i in range(4)}
    shapes[10] = [ring(40, lat, lng, 0.9, 10), ring(9, lat, lng, 0.3, 11)]
    shapes[11] = [ring(30, lat - 0.5, lng - 0.5, 0.4, 12), ring(30, lat + 0.5, lng + 0.5, 0.4, 13), ring(5, lat + 0.5, lng + 0.5, 0.1, 14)]
    shapes[12] = [[[lng - 0.5, lat - 0.5], [lng + 0.5, lat - 0.5], [lng + 0.5, lat + 0.5], [lng - 0.5, lat + 0.5]]]  # not closed
    texts = [(i, polygon(r)) for i, r in shapes.items() if i != 11]
    parts = wrapped(shapes[11])
    texts.append((11, json.dumps({"type": "MultiPolygon", "coordinates": [[parts[0]], [parts[1], parts[2]]]})))
    got = found(pg.stores_in_areas(areas_df(spark, texts), stores, max_broadcast_rows=rows))
    for i, rings in shapes.items():
        closed = [r if r[0] == r[-1] else r + r[:1] for r in rings]
        assert got.get(i, []) == np.flatnonzero(even_odd(lats, lngs, closed)).tolist(), i
    assert sum(map(len, got.values())) > 2000


def test_many_vertices_bounded_edges(spark):
    stores, lats, lngs = scatter(spark, 4000, (36.5, 38.5), (126, 128))
    big = ring(10_000, 37.5, 127.0, 0.9, 4)
    index = pg.area_cells(areas_df(spark, [(1, polygon([big]))])).cache()
    assert index.count() < 100_000
    edges = index.filter("edges is not null").agg(F.avg(F.size("edges")), F.max(F.size("edges"))).first()
    assert edges[0] < 40 and edges[1] < 1000
    # Cells without edges need no test, and there are some.
    assert index.filter("edges is null and corner").count() > 500
    got = found(pg.stores_in_areas(areas_df(spark, [(1, polygon([big]))]), stores))
    assert got[1] == np.flatnonzero(even_odd(lats, lngs, [big])).tolist()


def test_shared_borders_belong_to_one_side(spark):
    """Stores exactly on grid-like borders and corners are in one tile of a tiling, never in two or none."""
    xs = [127.0, 127.25, 127.5, 128.0]
    ys = [37.0, 37.125, 37.75]
    tiles = [(i * 10 + j, polygon([[[a, c], [b, c], [b, d], [a, d], [a, c]]]))
             for i, (a, b) in enumerate(zip(xs, xs[1:])) for j, (c, d) in enumerate(zip(ys, ys[1:]))]
    points = [(y, x) for y in (37.0, 37.05, 37.125, 37.5) for x in (127.0, 127.1, 127.25, 127.5, 127.75)]
    stores = spark.createDataFrame([(k, "A", y, x, None, None) for k, (y, x) in enumerate(points)], STORES)
    rows = pg.stores_in_areas(areas_df(spark, tiles), stores).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in rows} == dict.fromkeys(range(len(points)), 1)


def test_circles_beside_polygons_and_statistics(spark):
    from sitelens.operators import distance_join as dj
    rows = [(i, "AB"[i % 2] if i % 5 else None, 37.5 + (i % 40) / 1000, 127.0 + (i // 40) / 1000, None, None) for i in range(1600)]
    rows += [(2000, "A", None, 127.0, None, None), (2001, "A", 0.0, 179.9999, None, None)]
    stores = spark.createDataFrame(rows, STORES).withColumn("open_date", F.expr("date_add(date'2000-01-01', cast(id as int))")) \
        .withColumn("close_date", F.when(F.col("id") % 3 == 0, F.lit("2001-01-01").cast("date")))
    square = polygon([[[126.99, 37.49], [127.02, 37.49], [127.02, 37.52], [126.99, 37.52], [126.99, 37.49]]])
    areas = spark.createDataFrame([
        (1, square, None, None, None), (2, None, 37.52, 127.02, 1500.0), (3, None, 0.0, -179.9999, 100.0), (4, None, 10.0, 10.0, 50.0)],
        "area_id long, geojson string, lat double, lng double, radius_m double")
    got = found(pg.stores_in_areas(areas, stores))
    assert got[1] == [r[0] for r in rows if r[2] is not None and 126.99 <= r[3] < 127.02 and 37.49 <= r[2] < 37.52]
    sites = spark.createDataFrame([(2, 37.52, 127.02, 1500.0, None)], "site_id long, lat double, lng double, radius_m double, sector string")
    assert got[2] == sorted(r.id for r in dj.within_radius(dj.prepare_sites(sites), stores).collect())
    assert got[3] == [2001] and 4 not in got
    both = set(got[1]) & set(got[2])
    stats = {r.area_id: r for r in pg.area_statistics(areas, stores).collect()}
    assert both and stats[1].n_stores == len(got[1]) and stats[2].n_stores == len(got[2])  # overlap counts in each
    assert stats[4].n_stores == 0 and stats[4].top_sector is None and stats[3].n_open == sum(i % 3 != 0 for i in got[3])
    share = pg.area_sector_share(areas, stores).groupBy("area_id").agg(F.sum("share_pct").alias("p"), F.sum("n").alias("n")).collect()
    assert all(abs(r.p - 100) < 0.05 and r.n == stats[r.area_id].n_stores for r in share)


def test_rejected_areas(spark):
    good = ring(8, 10, 10, 1, 1)
    cap = [[x, 80.0] for x in (0.0, 90.0, 180.0, -90.0)]
    rows = [(1, polygon([good])), (2, "{not json"), (3, json.dumps({"type": "Point", "coordinates": [1.0, 2.0]})), (4, polygon([good[:2]])),
            (5, polygon([[[0.0, 0.0], [1.0, 95.0], [2.0, 0.0]]])), (6, json.dumps({"type": "Polygon", "coordinates": [cap]})),
            (None, polygon([good])), (7, None), (8, polygon([good])), (8, polygon([good])), (9, json.dumps({"type": "Polygon", "coordinates": []}))]
    areas = areas_df(spark, rows).union(spark.createDataFrame(
        [(20, None, 91.0, 0.0, 5.0), (21, None, 0.0, 0.0, -1.0), (22, None, 0.0, 137.5, None), (23, polygon([good]), 0.0, 0.0, 5.0)],
        "area_id long, geojson string, lat double, lng double, radius_m double"))
    got = {r.area_id: r.reasons for r in pg.rejected_areas(areas).collect()}
    assert got == {2: ["BAD_SHAPE"], 3: ["BAD_SHAPE"], 4: ["FEW_POINTS"], 5: ["BAD_COORDINATE"], 6: ["ROUND_A_POLE"], None: ["NO_ID"],
                   7: ["NO_SHAPE"], 8: ["REPEATED_ID"], 9: ["BAD_SHAPE"], 20: ["BAD_CENTRE"], 21: ["BAD_RADIUS"], 22: ["NO_SHAPE"],
                   23: ["TWO_SHAPES"]}
    stores, _, _ = scatter(spark, 50, (9, 11), (9, 11))
    assert {r.area_id for r in pg.stores_in_areas(areas, stores).collect()} == {1}
    assert pg.stores_in_areas(areas.limit(0), stores).collect() == [] and pg.stores_in_areas(areas, stores.limit(0)).collect() == []


def test_district_levels(spark):
    def box(a, b, c, d):
        return polygon([[[a, c], [b, c], [b, d], [a, d], [a, c]]])
    rows = [("si", 1, box(0.0, 4.0, 0.0, 4.0)), ("si", 2, box(4.0, 8.0, 0.0, 4.0)), ("gu", 11, box(0.0, 2.0, 0.0, 4.0)),
            ("gu", 12, box(2.0, 4.0, 0.0, 4.0)), ("dong", 111, box(0.0, 2.0, 0.0, 1.0))]
    districts = spark.createDataFrame(rows, "level string, area_id long, geojson string")
    stores = spark.createDataFrame([(1, 0.5, 0.5, None), (2, 2.0, 1.0, None), (3, 2.0, 3.0, None), (4, 2.0, 5.0, None), (5, 9.0, 9.0, None)],
                                   "id long, lat double, lng double, close_date date")
    paths = {r.id: (r.si, r.gu, r.dong) for r in pg.district_paths(districts, stores, ["si", "gu", "dong"]).collect()}
    assert paths == {1: (1, 11, 111), 2: (1, 11, None), 3: (1, 12, None), 4: (2, None, None)}
    total = {(r.si, r.gu, r.dong, r.level): r.n for r in pg.district_levels(districts, stores, ["si", "gu", "dong"]).collect()}
    assert total[(None, None, None, 7)] == 4 and total[(1, None, None, 3)] == 3 and total[(1, 11, None, 1)] == 2 and total[(1, 11, None, 0)] == 1
