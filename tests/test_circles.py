"""Sums and first rows of circles == brute force, without forming the pairs."""

import functools
import math
import random

import pytest
from pyspark.sql import functions as F

from sitelens.operators import circles as ci
from sitelens.operators import distance_join as dj
from sitelens.operators import nearby, patterns, scores
from sitelens.sources.sites import SITE_SCHEMA

STORE = "id long, sector string, open_date date, lat double, lng double"


def _crowd(n=1500, seed=7):
    """Stores around a town, on the date line, near a pole and far off; many share one place."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lat0, lng0, spread = rnd.choice([(37.5, 127.0, 0.02), (37.5, 127.0, 0.0005), (-12.0, 179.999, 0.02), (89.7, 20.0, 0.2), (0.0, 0.0, 30.0)])
        lng = (lng0 + rnd.uniform(-spread, spread) + 180.0) % 360.0 - 180.0
        out.append((i, rnd.choice(["A", "B", None]), None if i % 9 == 0 else f"20{i % 20 + 10}-01-01", lat0 + rnd.uniform(-spread, spread), lng))
    out += [(n + i, "A", "2015-01-01", 37.5001, 127.0001) for i in range(300)]
    return out


SITES = [(1, 37.5, 127.0, 1000.0, "A"), (2, 37.5, 127.0, 1000.0, None), (3, 37.5001, 127.0001, 0.0, None), (4, -12.0, -179.9995, 1500.0, "B"),
         (5, 89.7, 20.0, 9000.0, None), (6, 1.0, 1.0, 2_000_000.0, "A"), (7, 37.51, 127.01, 700.0, None), (8, 60.0, 60.0, 500.0, None),
         (9, 37.5001, 127.0001, 100.0, "A"), (9, 37.5, 127.0, 300.0, "A"), (10, 95.0, 0.0, 10.0, None), (11, 89.99, 0.0, 30_000.0, None)]


@pytest.fixture(scope="module")
def tables(spark):
    stores = spark.createDataFrame(_crowd(), "id long, sector string, open_date string, lat double, lng double") \
        .withColumn("open_date", F.col("open_date").cast("date"))
    return spark.createDataFrame(SITES, SITE_SCHEMA), stores


@pytest.mark.parametrize("most", [ci.MAX_STORES, 60])
@pytest.mark.parametrize("match", [True, False])
def test_sums_equal_brute_force(tables, most, match):
    sites, stores = tables
    s = dj.prepare_sites(sites)
    got = ci.circle_sums(s, stores, {"n": ("spheroid", F.lit(1)), "ids": ("haversine", F.col("id"))}, match, "sector", most, 3)
    got = {(r.site_id, r.sector): (r.n, r.ids) for r in got.groupBy("site_id", "sector").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids")).collect()}
    want = {}
    for metric, place, value in (("spheroid", 0, F.lit(1)), ("haversine", 1, F.col("id"))):
        for r in dj.within_radius(s, stores, metric, match).groupBy("site_id", "sector").agg(F.sum(value).alias("v")).collect():
            want.setdefault((r.site_id, r.sector), [0, 0])[place] = r.v
    assert {k: v for k, v in got.items() if any(v)} == {k: tuple(v) for k, v in want.items() if any(v)} and len(want) > 10


@pytest.mark.parametrize("k,most", [(3, ci.MAX_STORES), (40, 60)])
@pytest.mark.parametrize("sort", sorted(nearby.SORTS))
def test_first_rows_equal_brute_force(tables, sort, k, most, monkeypatch):
    from pyspark.sql import Window
    monkeypatch.setattr(nearby, "circle_first", functools.partial(ci.circle_first, max_stores=most))
    sites, stores = tables
    s = dj.prepare_sites(sites)
    w = Window.partitionBy("site_id").orderBy(*nearby._order(nearby.SORTS[sort]))
    top = lambda pairs: sorted((r.site_id, r.rn, r.id) for r in
                               pairs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).collect())
    assert top(nearby._first_rows(s, stores, sort, k)) == top(dj.within_radius(s, stores))


def test_rows_do_not_grow_with_pairs(spark):
    """4 000 stores within every circle: a site meets a few rows, not 4 000."""
    rnd = random.Random(3)
    stores = spark.createDataFrame([(i, "A", None, 37.5 + rnd.uniform(-.004, .004), 127.0 + rnd.uniform(-.004, .004)) for i in range(4000)], STORE)
    sites = dj.prepare_sites(spark.createDataFrame([(i, 37.5, 127.0 + i * 1e-6, 5000.0, None) for i in range(50)], SITE_SCHEMA))
    cells = 4
    assert ci.circle_sums(sites, stores, {"n": ("spheroid", F.lit(1))}).count() <= 50 * cells
    for sort in nearby.SORTS:
        assert nearby._first_rows(sites, stores, sort, 10).count() <= 50 * 10 * cells * ci.LOOSE
    assert {r.total_count for r in nearby.radius_page_meta(sites.select("site_id", F.col("site_lat").alias("lat"), F.col("site_lng").alias("lng"),
                                                                        "radius_m", F.col("site_sector").alias("sector")), stores).collect()} == {4000}


def test_few_stores_are_looked_at():
    """Of 20 000 stores inside a circle only those near its edge are open."""
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(5)
    lat, lng = 37.5 + rng.uniform(-.01, .01, 40_000), rng.uniform(-.01, .01, 40_000)
    c = ci.Circles(pa.table({"site_lat": [37.5], "site_lng": [0.0], "radius_m": [900.0]}), 0.0)
    strips = ci.Strips(lat, lng, np.arange(40_000), ("spheroid", "haversine"))
    (x, s, r, first, end), = strips.chunks(c, np.array([0]), c.radius)
    owner, o0, i0, i1, o1 = strips.spans(c, s, r, first, end)
    inside = strips.counts(c, s, r)[0]
    assert (i1 - i0).sum() <= inside <= (o1 - o0).sum() and inside > 20_000
    assert (o1 - o0).sum() - (i1 - i0).sum() < 40 * math.sqrt(inside)


def test_scores_and_potential_of_sites_given_twice(spark, tables):
    sites, stores = tables
    st = stores.withColumn("close_date", F.when(F.col("id") % 3 == 0, F.date_add("open_date", 100)))
    agg = {r.site_id: r for r in scores.site_aggregates(sites, st, "2031-01-01").collect()}
    both = dj.within_radius(dj.prepare_sites(sites), st, "spheroid", False)
    want = {r.site_id: (r.n, r.same) for r in both.groupBy("site_id").agg(
        F.count("*").alias("n"), F.count_if(dj.sector_match(F.col("site_sector"), F.col("sector"))).alias("same")).collect()}
    assert {i: (r.n_all, r.n_same) for i, r in agg.items() if r.n_all} == want
    near = dj.within_radius(dj.prepare_sites(sites), st.filter("close_date is not null")).groupBy("site_id").count()
    got = {r.site_id: r.n_closed for r in patterns.market_potential(sites, st).collect() if r.n_closed}
    assert got == {r.site_id: r["count"] for r in near.collect()}


def test_pairs_of_lists_are_narrow(tables):
    """Only what ranks a store travels with a pair; texts are joined to the rows shown."""
    sites, stores = tables
    wide = stores.withColumn("store_name", F.lit("n")).withColumn("address", F.lit("a")).withColumn("close_date", F.lit(None).cast("date"))
    for sort, extra in (("distance_asc", set()), ("distance_desc", set()), ("open_date_asc", {"open_date"}), ("sector_asc", {"sector", "open_date"})):
        assert set(nearby._first_rows(dj.prepare_sites(sites), wide, sort, 5).columns) == {"site_id", "id", "distance_m"} | extra


def test_stores_are_derived_once(spark, tables, monkeypatch):
    sites, stores = tables
    wide = stores.withColumn("store_name", F.lit("n")).withColumn("address", F.lit("a")).withColumn("close_date", F.lit(None).cast("date"))
    written, once = [], ci.located
    for module in (ci, nearby, patterns, scores):
        monkeypatch.setattr(module, "located", lambda df: written.append(df.columns) or once(df))
    for query in (lambda: nearby.radius_page(sites, wide, "distance_desc", 2, 3), lambda: patterns.competition_index(sites, wide),
                  lambda: scores.site_aggregates(sites, wide, "2031-01-01")):
        written.clear()
        query()
        assert len(written) == 1


def test_places_enclose_every_longitude():
    """Column bounds against a search, in even strips, in crowds and at one place."""
    import numpy as np
    rng = np.random.default_rng(9)
    for lng in (rng.uniform(-1, 1, 3000), np.concatenate([rng.normal(0.3, 1e-7, 2900), rng.uniform(-1, 1, 100)]), np.full(500, 0.25), np.array([0.5])):
        n = len(lng)
        s = ci.Strips(rng.uniform(-1, 1, n), lng, np.arange(n), ("spheroid",))
        x = np.concatenate([rng.uniform(-1.5, 1.5, 400), rng.choice(lng, 400), [lng.min(), lng.max(), -1e6, 1e6]])
        strip = rng.integers(0, len(s.low), len(x))
        a, b = s.places(strip, x)
        starts = np.arange(len(s.low)) * s.size
        place = np.array([i + np.searchsorted(s.lng[i:i + s.size], v) for i, v in zip(starts[strip], x)])
        assert (a <= place).all() and (place <= b).all() and (b - a).max() <= ci.CROWDED


def test_squares_order_as_distances():
    import numpy as np
    rng = np.random.default_rng(4)
    lat, lng = rng.uniform(-85, 85, 5000), rng.uniform(-179, 179, 5000)
    lat2, lng2 = lat + rng.uniform(-.2, .2, 5000), lng + rng.uniform(-.2, .2, 5000)
    for m in ("spheroid", "haversine"):
        d = ci._distance(m, lat, lng, lat2, lng2)
        sq = ci._squared(m, lat, np.cos(np.radians(lat)), lng, lat2, np.cos(np.radians(lat2)), lng2)
        for r in (100.0, 5000.0, 20_000.0):
            slack = ci.SLACK_M + ci.SLACK * r
            low, high = (ci._limit(m, np.array([v])) for v in (r - slack, r + slack))
            assert (d[sq < low] <= r).all() and (d[sq > high] > r).all()
            assert not ((sq >= low) & (d < r - 2 * slack)).any() and not ((sq <= high) & (d > r + 2 * slack)).any()


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("sort", ["distance_desc", "open_date_asc", None])
def test_lists_by_parts_of_sites(spark, tables, sort, monkeypatch):
    """Parts of sites, and parts of a group's sites, give the same rows; a part's shuffle files are given back."""
    sites, stores = tables
    wide = stores.withColumn("store_name", F.lit("n")).withColumn("address", F.lit("a"))
    query = lambda: nearby.radius_list(sites, wide, 7) if sort is None else nearby.radius_page(sites, wide, sort, 2, 3)
    want, parts, once = _rows(query()), [], nearby._ranked
    monkeypatch.setattr(nearby, "MAX_PART_ROWS", 20)
    monkeypatch.setattr(ci, "MAX_WANTED", 10)
    monkeypatch.setattr(nearby, "_ranked", lambda *a: parts.append(1) or once(*a))
    free = spark.conf.get(ci.FREE_SHUFFLES)
    assert _rows(query()) == want and want and len(parts) > 2
    assert spark.conf.get(ci.FREE_SHUFFLES) == free


def test_many_sites_copy_no_stores(spark, monkeypatch):
    """The stores of a cell are shuffled once, however many rows its sites want."""
    monkeypatch.setattr(ci, "MAX_WANTED", 20)
    stores = spark.createDataFrame([(i, "A", None, 37.5 + i * 1e-6, 127.0) for i in range(300)], STORE)
    sites = dj.prepare_sites(spark.createDataFrame([(i, 37.5, 127.0, 500.0, "A") for i in range(200)], SITE_SCHEMA))
    met = []
    once = ci._met
    monkeypatch.setattr(ci, "_met", lambda *a: met.append(once(*a)) or met[-1])
    pairs = nearby._first_rows(sites, stores, "open_date_asc", 10)
    assert pairs.groupBy("site_id").count().filter("count >= 10").count() == 200
    assert met[0][1].count() == 2 * 300  # by sector, and for sites without one; before: 100 times as many
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(level") == 1  # before: two for either side
