"""Grid distance join == brute force; salted path == broadcast path; the
date line and the poles; plan shape."""

import math

import pytest
from pyspark.sql import functions as F

from sitelens.operators import distance_join as dj
from sitelens.operators import nearby
from sitelens.sources.sites import SITE_SCHEMA, customer_sites, landmark_sites
from sitelens.sources.store_view import store_view
from tests.conftest import SF0001
from tests.oracle import duck

# Stores within r of landmark sites 1..9 at sf0.001, haversine.
EXPECTED_HAVERSINE = {
    500.0: [4, 7, 6, 4, 5, 2, 4, 4, 0],
    1000.0: [18, 19, 21, 19, 20, 6, 20, 18, 0],
    2000.0: [80, 75, 76, 79, 75, 35, 73, 77, 0],
}


def _counts(pairs):
    got = {r["site_id"]: r["n"] for r in pairs.groupBy("site_id").agg(F.count("*").alias("n")).collect()}
    return [got.get(i, 0) for i in range(1, 10)]


@pytest.mark.parametrize("radius", sorted(EXPECTED_HAVERSINE))
def test_landmark_counts_haversine(spark, radius):
    stores = store_view(spark, SF0001)
    pairs = dj.within_radius(dj.prepare_sites(landmark_sites(spark, radius)), stores, "haversine", False)
    assert _counts(pairs) == EXPECTED_HAVERSINE[radius]


def test_larger_radius_never_fewer(spark):
    stores = store_view(spark, SF0001)
    prev = None
    for r in (100.0, 500.0, 1000.0, 2000.0, 5000.0):
        c = _counts(dj.within_radius(dj.prepare_sites(landmark_sites(spark, r)), stores))
        if prev:
            assert all(a >= b for a, b in zip(c, prev))
        prev = c


def _brute(spark, sites_df, stores_df, metric):
    """Brute force in DuckDB over the same rows (small fixture only)."""
    from sitelens.functions import geo
    con = duck(SF0001)
    con.register("s", sites_df.toPandas())
    con.register("st", stores_df.select("id", "sector", "lat", "lng").toPandas())
    d = geo.distance_sql(metric, "s.lat", "s.lng", "st.lat", "st.lng")
    rows = con.sql(f"SELECT s.site_id, st.id FROM s, st WHERE st.lat IS NOT NULL AND "
                   f"(s.sector IS NULL OR s.sector = st.sector) AND {d} <= s.radius_m").fetchall()
    return sorted(rows)


@pytest.mark.parametrize("force", ["broadcast", "salted"])
@pytest.mark.parametrize("levels", [dj.GRID_LEVELS, (0.01, 0.005, 0.0025, 0.00125)])
def test_grid_equals_brute_force(spark, force, levels):
    sites = customer_sites(spark, SF0001)
    stores = store_view(spark, SF0001)
    plan = dj.JoinPlan(grid_levels=levels, force=force, hot_rows=7)
    got = sorted((r["site_id"], r["id"]) for r in
                 dj.within_radius(dj.prepare_sites(sites), stores, "spheroid", True, plan)
                 .select("site_id", "id").collect())
    assert got == _brute(spark, sites, stores, "spheroid")


def _ring(lat0, lng0, n, radius_m):
    out = []
    for k in range(n):
        ang = 2 * math.pi * k / n
        dlat = radius_m * math.cos(ang) / 111_000.0
        dlng = radius_m * math.sin(ang) / (111_000.0 * max(math.cos(math.radians(lat0)), 1e-6))
        lng = lng0 + dlng
        lng = lng - 360 if lng > 180 else lng + 360 if lng < -180 else lng
        out.append((max(min(lat0 + dlat, 90.0), -90.0), lng))
    return out


@pytest.mark.parametrize("lat0,lng0", [(10.0, 179.9995), (-20.0, -179.9999), (89.999, 30.0), (-89.9995, -120.0)])
def test_date_line_and_poles(spark, lat0, lng0):
    pts = _ring(lat0, lng0, 24, 300.0) + _ring(lat0, lng0, 24, 800.0) + _ring(lat0, lng0, 12, 3000.0)
    stores = spark.createDataFrame([(i, "A", float(a), float(b)) for i, (a, b) in enumerate(pts)],
                                   "id long, sector string, lat double, lng double")
    sites = spark.createDataFrame([(1, lat0, lng0, 1000.0, None)], SITE_SCHEMA)
    got = sorted((r["site_id"], r["id"]) for r in
                 dj.within_radius(dj.prepare_sites(sites), stores, "spheroid").select("site_id", "id").collect())
    assert got == _brute(spark, sites, stores, "spheroid")
    assert len(got) >= 24  # the 300 m ring is always inside


def test_plan_has_no_cartesian_or_nested_loop(spark):
    from sitelens.plans import inspect
    df = nearby.competition_count(customer_sites(spark, SF0001), store_view(spark, SF0001))
    inspect.assert_no_cross_product(df)
    assert "BroadcastHashJoin" in inspect.join_strategies(df)


def test_no_registered_query_plans_a_cross_product(spark):
    import __spark_entry__ as E
    from sitelens.plans import inspect
    skip = {"nearest_stores", "dense_clusters"}  # iterative: checked in their own tests
    for name, fn in E.queries().items():
        if name not in skip:
            inspect.assert_no_cross_product(fn(spark, SF0001))


def test_distance_not_inlined_into_join_condition(spark):
    df = dj.within_radius(dj.prepare_sites(customer_sites(spark, SF0001)), store_view(spark, SF0001))
    plan = df._jdf.queryExecution().executedPlan().toString()
    join_lines = [ln for ln in plan.splitlines() if "BroadcastHashJoin" in ln]
    assert join_lines and not any("SIN(" in ln.upper() for ln in join_lines)


def test_radius_list_uses_partial_window_group_limit(spark):
    df = nearby.radius_list(customer_sites(spark, SF0001), store_view(spark, SF0001))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_empty_site_gets_zero(spark):
    stores = store_view(spark, SF0001)
    out = {r["site_id"]: r["total_count"] for r in
           nearby.competition_count(landmark_sites(spark, 500.0), stores).collect()}
    assert out[9] == 0 and len(out) == 9


def test_list_rows_within_radius_and_capped(spark):
    stores = store_view(spark, SF0001)
    lst = nearby.radius_list(landmark_sites(spark, 5000.0), stores)
    per_site = {r["site_id"]: r["n"] for r in lst.groupBy("site_id").agg(F.count("*").alias("n")).collect()}
    assert max(per_site.values()) <= 100
    assert 9 not in per_site


def test_hot_cell_is_split_by_salting(spark):
    # one cell holds a third of all stores, and many sites sit in it
    hot = [(i, "A", 37.5051 + (i % 50) * 1e-5, 127.0051 + (i // 50) * 1e-5) for i in range(600)]
    rest = [(1000 + i, "A", 37.48 + (i % 40) * 0.003, 126.91 + (i // 40) * 0.004) for i in range(1200)]
    stores = spark.createDataFrame(hot + rest, "id long, sector string, lat double, lng double")
    sites = spark.createDataFrame([(i, 37.5055, 127.0055, 50.0, None) for i in range(40)], SITE_SCHEMA)
    plan = dj.JoinPlan(force="salted", hot_rows=50)
    sc = dj.site_cells(dj.prepare_sites(sites), plan.grid_levels)
    st = dj.store_cells(stores, plan.grid_levels)
    st2, sc2 = dj.salt_sides(sc, st, plan.hot_rows, dj.KEY)
    key = dj.KEY + ["salt_a", "salt_b"]
    assert st2.groupBy(*key).count().agg(F.max("count")).first()[0] <= 50
    assert sc2.groupBy(*key).count().agg(F.max("count")).first()[0] <= 50
    got = sorted((r["site_id"], r["id"]) for r in
                 dj.within_radius(dj.prepare_sites(sites), stores, "spheroid", True, plan).select("site_id", "id").collect())
    assert got == _brute(spark, sites, stores, "spheroid") and len(got) > 0


def test_size_check_falls_back_to_salted_join(spark):
    from sitelens.plans import inspect
    sites, stores = customer_sites(spark, SF0001), store_view(spark, SF0001)
    small = dj.JoinPlan(broadcast_max_rows=1)  # site cells exceed the bound -> no broadcast of sites
    a = dj.within_radius(dj.prepare_sites(sites), stores, "spheroid", True, small)
    b = dj.within_radius(dj.prepare_sites(sites), stores, "spheroid", True)
    assert sorted((r["site_id"], r["id"]) for r in a.select("site_id", "id").collect()) == \
        sorted((r["site_id"], r["id"]) for r in b.select("site_id", "id").collect())
    assert "SortMergeJoin" in inspect.join_strategies(a) or "ShuffledHashJoin" in inspect.join_strategies(a)


def test_bad_and_wide_sites_make_few_cells(spark):
    """A site off the Earth makes no cell and is reported; wide circles and circles near a pole take larger cells."""
    from sitelens.operators import quality
    rows = [(1, 137.5, 127.0, 500.0, None), (2, 37.5, 200.0, 500.0, None), (3, 37.5, 127.0, float("inf"), None), (4, None, 127.0, 500.0, None),
            (5, 37.5, 127.0, 1_000_000.0, None), (6, 89.99, 0.0, 5_000.0, None), (7, 37.55, 127.0, 500.0, None)]
    sites = spark.createDataFrame(rows, SITE_SCHEMA)
    assert {r.site_id for r in quality.rejected_sites(sites).collect()} == {1, 2, 3, 4, 5}
    usable = dj.usable_sites(dj.prepare_sites(sites))
    levels, cells = dj.needed_levels(usable, dj.GRID_LEVELS)
    assert cells < 2_000 and 0.01 in levels and len(levels) <= 3
    stores = store_view(spark, SF0001).filter("lat is not null")
    near = {r.site_id: r.total_count for r in nearby.competition_count(sites, stores).collect()}
    assert near[5] == stores.count() and near[7] > 0
    assert [near[i] for i in (1, 2, 3, 4, 6)] == [0] * 5
