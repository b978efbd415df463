"""Results that must not depend on caps, duplicates, missing values or far places."""

import math

import pytest
from pyspark.sql import functions as F

from sitelens.operators import areas, nearest
from sitelens.operators import distance_join as dj
from sitelens.operators import scores as sc
from sitelens.operators import shapes as sh
from sitelens.sources.sites import SITE_SCHEMA

STORE = "id long, sector string, lat double, lng double"
DATED = "id long, store_name string, sector string, address string, open_date date, close_date date, lat double, lng double"


def great_circle(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 6371000.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_nearest_reaches_the_whole_earth(spark):
    stores = spark.createDataFrame([(1, "A", -60.0, 60.0), (2, "A", 0.0, 179.9), (3, "B", 10.0, 10.0), (4, None, 10.0, 10.001)], STORE)
    sites = spark.createDataFrame([(1, 60.0, -120.0, 1.0, "A"), (2, 0.0, 0.0, 1.0, "A"), (3, 10.0, 10.0, 1.0, None),
                                   (4, 89.9, 0.0, 1.0, "B"), (5, None, 0.0, 1.0, "A"), (6, 0.0, -179.9, 1.0, " ")], SITE_SCHEMA)
    got = {}
    for r in nearest.nearest_stores(sites, stores, n=2).collect():
        got.setdefault(r["site_id"], []).append((r["rank"], r["id"], r["distance_m"]))
    assert {k: [x[1] for x in sorted(v)] for k, v in got.items()} == {1: [2, 1], 2: [1, 2], 3: [3, 4], 4: [3], 6: [2, 1]}
    far = dict((x[1], x[2]) for x in got[1])
    assert far[1] == pytest.approx(great_circle(60, -120, -60, 60), abs=0.01)
    assert far[2] == pytest.approx(great_circle(60, -120, 0, 179.9), abs=0.01)


def test_equal_stores_inside_a_polygon_all_count(spark):
    stores = spark.createDataFrame([(1, "A", 0.5, 0.5), (1, "A", 0.5, 0.5), (2, "A", 0.2, 0.7), (3, "A", 5.0, 5.0)], STORE)
    ring = [{"lat": a, "lng": b} for a, b in [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]]
    polygons = spark.createDataFrame([(1, ring)], "poly_id long, vertices array<struct<lat double, lng double>>")
    for limit in (2_000_000, 1):  # broadcast and salted
        got = sh.stores_in_polygons(polygons, stores, limit)
        assert sorted(r["id"] for r in got.collect()) == [1, 1, 2]


def test_route_sector_filter(spark):
    stores = spark.createDataFrame([(1, "A", 0.0, 0.0), (2, "B", 0.0, 0.0)], STORE)
    pts = [{"lat": 0.0, "lng": -0.01}, {"lat": 0.0, "lng": 0.01}]
    routes = spark.createDataFrame([(1, 50.0, pts)], "route_id long, radius_m double, points array<struct<lat double, lng double>>")
    assert [r["id"] for r in sh.stores_along_routes(routes, stores, sector="B").collect()] == [2]


def test_snapped_scores_use_the_true_radius_and_sector(spark):
    import datetime as dt
    stores = spark.createDataFrame([(1, "n", "A", "a", dt.date(2000, 1, 1), None, 37.5, 127.0),
                                    (2, "n", "all", "a", dt.date(2000, 1, 1), None, 37.6, 127.0)], DATED)
    sites = spark.createDataFrame([(1, 37.5002, 127.0, 40.0, None), (2, 37.5, 127.0, 1000.0, None), (3, 37.5, 127.0, 1000.0, "all"),
                                   (4, 37.5, 127.0, 1000.0, " ")], SITE_SCHEMA)
    plain = {r["site_id"]: r["competition_level"] for r in sc.survival_score(sites, stores, "2001-06-30").collect()}
    snap = {r["site_id"]: r["competition_level"] for r in sc.survival_score_snapped(sites, stores, "2001-06-30").collect()}
    assert plain == snap == {1: 1, 2: 1, 3: 0, 4: 1}


def test_reported_counts_are_exact(spark):
    import datetime as dt
    stores = spark.createDataFrame([(i, "n", "A", "a", dt.date(2000, 1, 1), None, 37.5, 127.0) for i in range(150)], DATED)
    sites = spark.createDataFrame([(1, 37.5, 127.0, 100.0, "A")], SITE_SCHEMA)
    assert sc.survival_score(sites, stores, "2001-06-30").first()["competition_level"] == 150
    assert sc.site_rating(sites, stores, "2001-06-30").first()["nearby_stores"] == 150


def test_search_text_is_literal(spark):
    import datetime as dt
    day = dt.date(2000, 1, 1)
    rows = [(1, "100% juice", "A", "x", day, None, None, None), (2, "1000 juice", "A", "x", day, None, None, None),
            (3, "a_b", "B", "x", day, None, None, None), (4, "aXb", "B", "x", day, None, None, None)]
    stores = spark.createDataFrame(rows, DATED)
    find = lambda **k: [r["id"] for r in areas.search_page(stores, **k).orderBy("rn").collect()]
    assert find(text="100% J") == [1] and find(text="a_b") == [3]
    assert find(text="juice", sector="A", sort="name") == [1, 2] and find(sector="B", page=2, page_size=1) == [4]
    assert find(sector=" ") == [1, 2, 3, 4]


def test_a_cell_crowded_on_both_sides_is_split(spark):
    stores = spark.range(900).select(F.col("id"), F.lit("A").alias("sector"), F.lit(37.5051).alias("lat"), F.lit(127.0051).alias("lng"))
    sites = spark.range(900).select(F.col("id").alias("site_id"), F.lit(37.5051).alias("lat"), F.lit(127.0051).alias("lng"),
                                    F.lit(10.0).alias("radius_m"), F.lit(None).cast("string").alias("sector"))
    cells = dj.site_cells(dj.prepare_sites(sites), dj.GRID_LEVELS)
    st, sites2 = dj.salt_sides(cells, dj.store_cells(stores, dj.GRID_LEVELS), 1000, dj.KEY, hot_pairs=40_000)
    key = [*dj.KEY, "salt_a", "salt_b"]
    pairs = st.groupBy(*key).agg(F.count("*").alias("n")).join(sites2.groupBy(*key).agg(F.count("*").alias("m")), key)
    worst, total = pairs.agg(F.max(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("m"))).first()
    assert total == 810_000 and worst <= 40_000


def test_a_long_snake_of_cells_is_one_cluster(spark):
    from sitelens.operators.patterns import connected_cells
    snake = [(x, 0 if x % 4 < 2 else 1, 1) for x in range(300)] + [(1000, 1000, 1)]
    got = connected_cells(spark.createDataFrame(snake, "cx long, cy long, n long")).collect()
    assert len(got) == 301 and len({r["cluster"] for r in got}) == 2 and min(r["cluster"] for r in got) == 0


def test_saved_survival_keeps_the_first_calculation_time(spark, scratch):
    import datetime as dt

    from sitelens.operators import survival as sv
    folder = f"{scratch}/survival"
    batch = lambda rows: spark.createDataFrame(rows, "sector string, avg_duration_days double, sample_size long")
    t1, t2 = dt.datetime(2000, 1, 1), dt.datetime(2001, 1, 1)
    assert sv.load_survival(spark, folder) is None
    assert sv.save_survival(sv.survival_table(batch([("A", 1.0, 1), ("B", 2.0, 2)]), t1), folder) == 1
    assert sv.save_survival(sv.survival_upsert(sv.load_survival(spark, folder), batch([("A", 5.0, 9), ("C", 3.0, 3)]), t2), folder) == 2
    got = {r["sector"]: (r["avg_duration_days"], r["calculated_at"], r["updated_at"]) for r in sv.load_survival(spark, folder).collect()}
    assert got == {"A": (5.0, t1, t2), "B": (2.0, t1, t1), "C": (3.0, t2, t2)}
