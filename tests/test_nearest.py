"""Nearest stores by the quadtree of counts: exact, and few candidates at any density."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.operators import distance_join as dj
from sitelens.operators import nearest as nn

SITES = "site_id long, lat double, lng double, radius_m double, sector string"
STORES = "id long, sector string, lat double, lng double"


def metric(a, b, c, d):
    """The global metric in plain Python."""
    phm = math.radians((a + c) / 2)
    s = math.sin(phm)
    w = math.sqrt(1 - geo.WGS84_E2 * s * s)
    dl = (d - b + 180) % 360 - 180
    f = math.hypot(geo.WGS84_A * (1 - geo.WGS84_E2) / w ** 3 * math.radians(c - a), geo.WGS84_A / w * math.cos(phm) * math.radians(dl))
    if f <= geo.NEAR_M:
        return f
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(dl) / 2) ** 2
    return max(2 * geo.EARTH_R * math.atan2(math.sqrt(h), math.sqrt(1 - h)), geo.NEAR_M)


def brute(sites, stores, n):
    out = []
    for i, lat, lng, _, sector in sites:
        near = sorted((metric(lat, lng, c, d), k) for k, s, c, d in stores if c is not None and (sector is None or s == sector))
        out += [(i, r + 1, k) for r, (_, k) in enumerate(near[:n])]
    return sorted(out)


def world():
    rnd = np.random.default_rng(4)
    stores = []
    for lat, lng, spread, n in [(37.5, 127, 0.05, 400), (37.9, 127.4, 0.0005, 300), (0, 179.999, 0.01, 60), (89.9, 10, 0.05, 20), (-45, -70, 2, 30)]:
        stores += [("AB"[k % 2], float(min(90, a)), float((b + 180) % 360 - 180)) for k, (a, b) in
                   enumerate(zip(rnd.normal(lat, spread, n), rnd.normal(lng, spread, n)))]
    stores = [(i, *s) for i, s in enumerate(stores)] + [(9000, "A", None, 1.0)]
    stores += [(9001 + i, "A", 37.5, 127.0) for i in range(40)]  # many at one point
    points = [(37.5, 127.0), (37.51, 127.03), (37.9, 127.4), (37.88, 127.4), (37.7, 127.2), (0, -179.99), (89.99, -170), (-90, 0), (10, 20), (-45, -70), (37.9003, 127.4)]
    sites = [(i, float(a), float(b), None, [None, "A", "B", " "][i % 4]) for i, (a, b) in enumerate(points)]
    return sites, stores


@pytest.mark.parametrize("crowded", [nn.CROWDED, 2])
def test_exact_everywhere(spark, monkeypatch, crowded):
    monkeypatch.setattr(nn, "CROWDED", crowded)
    sites, stores = world()
    got = nn.nearest_stores(spark.createDataFrame(sites, SITES), spark.createDataFrame(stores, STORES), 4).collect()
    plain = [(i, a, b, r, s.strip() or None if s else None) for i, a, b, r, s in sites]
    assert sorted((r.site_id, r.rank, r.id) for r in got) == brute(plain, stores, 4)


def candidates(spark, stores, sites, n):
    df = spark.createDataFrame(stores, STORES)
    s = dj.prepare_sites(spark.createDataFrame(sites, SITES).withColumn("radius_m", F.lit(0.0))).drop("radius_m")
    reach = nn.search_radii(s, df, n)
    return {r.site_id: r.n for r in dj.within_radius(s.join(reach, "site_id"), df, "global", True).groupBy("site_id")
            .agg(F.count(F.lit(1)).alias("n")).collect()}


def test_few_candidates_at_every_density(spark):
    """Sparse, 10,000 times denser, an empty place beside a crowd, and a far site: all meet a small multiple of N."""
    rnd = np.random.default_rng(6)
    sparse = [("A", float(a), float(b)) for a, b in zip(rnd.uniform(30, 32, 2000), rnd.uniform(100, 102, 2000))]
    dense = [("A", float(a), float(b)) for a, b in zip(rnd.uniform(36, 36.02, 8000), rnd.uniform(110, 110.02, 8000))]
    stores = [(i, *s) for i, s in enumerate(sparse + dense)]
    sites = [(i, float(a), float(b), None, None) for i, (a, b) in enumerate(zip(rnd.uniform(30.2, 31.8, 40), rnd.uniform(100.2, 101.8, 40)))]
    sites += [(100 + i, float(a), float(b), None, None) for i, (a, b) in enumerate(zip(rnd.uniform(36.002, 36.018, 40), rnd.uniform(110.002, 110.018, 40)))]
    sites += [(200, 36.01, 110.1, None, None), (201, 36.5, 110.01, None, None), (202, -30.0, 0.0, None, None)]
    got = candidates(spark, stores, sites, 5)
    assert min(got.values()) >= 5 and len(got) == len(sites)
    assert np.mean([got[s[0]] for s in sites[:40]]) < 60 and np.mean([got[s[0]] for s in sites[40:80]]) < 60
    assert max(got.values()) <= nn.CROWDED * 5


def test_far_sites_meet_few_stores(spark):
    """Sites thousands of kilometres away join the stores of the cells left, not all that their circles' cells hold."""
    rnd = np.random.default_rng(8)
    stores = spark.createDataFrame([(i, "A", float(a), float(b)) for i, (a, b) in
                                    enumerate(zip(rnd.uniform(37.4, 37.6, 5000), rnd.uniform(126.9, 127.1, 5000)))], STORES)
    sites = spark.createDataFrame([(i, float(a), float(b), None, None) for i, (a, b) in
                                   enumerate(zip(rnd.uniform(-50, -20, 20), rnd.uniform(-60, 20, 20)))], SITES)
    s = dj.prepare_sites(sites.withColumn("radius_m", F.lit(0.0))).drop("radius_m")
    reach, cells = nn._search(s, stores, 5, True)
    met = nn._pairs(s.join(reach, "site_id").withColumn("radius_m", F.lit(1e9)).withColumn("sk", F.lit(dj.ANY_SECTOR)), cells, stores, True)
    found = [r["count"] for r in met.groupBy("site_id").count().collect()]
    assert len(found) == 20 and max(found) <= nn.CROWDED * 5
