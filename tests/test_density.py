"""Density clusters against the definition on small tables: crowds, copies, poles, 180 degrees."""

import math
import random

import pytest

from sitelens.functions.geo import EARTH_R
from sitelens.operators import density as dn
from sitelens.operators.distance_join import JoinPlan

SCHEMA = "id long, sector string, lat double, lng double"


def brute(rows, eps_m, min_points):
    reach = dn.chord(eps_m)
    xyz = {}
    for i, sector, lat, lng in rows:
        if lat is not None and lng is not None and abs(lat) <= 90 and abs(lng) <= 180:
            a, b = math.radians(lat), math.radians(lng)
            xyz[i] = (sector or "", EARTH_R * math.cos(a) * math.cos(b), EARTH_R * math.cos(a) * math.sin(b), EARTH_R * math.sin(a))
    near = {i: [j for j, q in xyz.items() if p[0] == q[0] and math.dist(p[1:], q[1:]) <= reach] for i, p in xyz.items()}
    core = {i for i in xyz if len(near[i]) >= min_points}
    name = {}
    for i in sorted(core):
        todo = [i] if i not in name else []
        while todo:
            k = todo.pop()
            if k not in name:
                name[k] = i
                todo += [j for j in near[k] if j in core]
    out = {}
    for i in xyz:
        met = [name[j] for j in near[i] if j in core]
        out[i] = ("core", name[i]) if i in core else ("border", min(met)) if met else ("noise", None)
    return out


def made():
    rng = random.Random(7)
    rows = []

    def add(sector, lat, lng, spread_m, count):
        for _ in range(count):
            rows.append((len(rows), sector, lat + rng.gauss(0, spread_m) / 111_000,
                         lng + rng.gauss(0, spread_m) / 111_000 / max(0.01, math.cos(math.radians(lat)))))

    for sector in ("cafe", "bar", None):
        add(sector, 37.5, 127.0, 900, 120)        # loose town
        add(sector, 37.52, 127.03, 40, 60)        # crowd in a few cubes
        add(sector, 37.5235, 127.03, 40, 60)      # second crowd, about 390 m on
    add("cafe", -17.0, 180.0 - 0.0005, 20, 8)     # on both sides of 180 degrees
    add("cafe", -17.0, -180.0 + 0.0005, 20, 8)
    rows += [(len(rows) + k, "cafe", 90.0 - 0.0005 * (k % 2), 40.0 * k - 170) for k in range(8)]  # around the pole
    rows += [(len(rows) + k, "bar", 37.6, 127.2) for k in range(40)]  # copies of one point
    rows += [(len(rows), "bar", 37.6013, 127.2), (len(rows) + 1, "bar", None, 127.0), (len(rows) + 2, "bar", 137.5, 0.0)]
    return [(i, s, a, b if b is None or abs(b) <= 180 else b - math.copysign(360, b)) for i, s, a, b in rows]


@pytest.mark.parametrize("plan, leaf", [(JoinPlan(), dn.LEAF_PAIRS), (JoinPlan(hot_rows=20, hot_pairs=200), 4)])
def test_equals_the_definition(spark, plan, leaf):
    rows = made()
    want = brute(rows, 150.0, 5)
    got = dn.density_clusters(spark.createDataFrame(rows, SCHEMA), 150.0, 5, plan, leaf).collect()
    assert len(got) == len(want) and {r.id: (r.role, r.cluster) for r in got} == want
    roles = [r.role for r in got]
    assert min(roles.count(x) for x in ("core", "border", "noise")) >= 5


def test_crowds_make_few_pairs(spark):
    """Two crowds in neighbouring cubes, just out of reach or just within: boxes decide, not all pairs of stores."""
    rng = random.Random(3)
    reach, n = dn.chord(100.0), 3_000
    side = reach / math.sqrt(3.0)
    spots = [(i, "s", 0.0, rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(n)]
    for gap, linked in ((reach + 1e-6, 0), (reach - 1e-6, 1)):
        both = spots + [(n + i, "s", gap, y, z) for i, _, _, y, z in spots]
        df = spark.createDataFrame(both, "id long, grp string, x double, y double, z double") \
            .withColumn("cell", dn.F.struct("grp", *dn._cells(side)))
        cells = sorted(tuple(r.cell) for r in df.select("cell").distinct().collect())
        pairs = df.select("cell").distinct().crossJoin(df.select(dn.F.col("cell").alias("b")).distinct()) \
            .selectExpr("cell as a", "b").filter("a.cx = 0 and b.cx > 0 and a.cy = b.cy and a.cz = b.cz")
        assert len(cells) >= 2
        found = [r for part in dn.dense_links(df, pairs, reach, side) for r in part.collect()]
        assert bool(found) == bool(linked)


def test_empty_and_alone(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dn.density_clusters(none).collect() == [] and dn.cluster_summary(none).collect() == []
    one = spark.createDataFrame([(5, "s", 1.0, 2.0)], SCHEMA)
    assert [tuple(r) for r in dn.density_clusters(one, 10.0, 1).collect()] == [(5, "s", "core", 5)]
    assert [tuple(r) for r in dn.density_clusters(one, 10.0, 2).collect()] == [(5, "s", "noise", None)]
