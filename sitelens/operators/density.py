"""Clusters by density reachability, all sectors in one run.

A store is **core** when at least ``min_points`` stores of its sector, itself
included, lie within ``eps_m``; core stores within ``eps_m`` of each other
share a cluster; other stores within ``eps_m`` of a core store are **border**
stores (of the smallest such cluster id), the rest are **noise**.  The cluster
id is the smallest store id among its core stores.  ``eps_m`` is measured as
the straight chord of the sphere, so poles and 180 degrees need no care.

How it stays linear where a sector crowds one spot:

* stores at one point are one **place** with a weight (partial aggregation);
* places fall in cubes of side ``eps / sqrt(3)``: stores of one cube are all
  within ``eps``, so a cube of ``min_points`` stores is **dense** -- all core,
  one cluster, no pair looked at.  Only places of thin cubes, fewer than
  ``min_points`` a cube, are compared with places of the cubes around, which
  bounds the pairs by stores x 124 x ``min_points``;
* two dense cubes are compared by boxes of their places, split in rounds: one
  pair of boxes wholly within ``eps`` links them, boxes farther apart fall away,
  only small boxes are compared place by place;
* clusters are components of cubes, not of stores;
* joins on a cube are salted where it is hot (``distance_join.salted_join``).

Stores without a place on Earth are left out; stores without a sector form a
group of their own; store ids are taken as unique (the key of the store table).
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.geo import EARTH_R
from sitelens.operators.components import checkpoint, components
from sitelens.operators.distance_join import DEFAULT_PLAN, JoinPlan, salted_join

AXES = ("x", "y", "z")
# Cubes that can hold stores within eps of a cube's own: two on along each axis; one of each opposite pair.
HALF_OFFSETS = [d for d in itertools.product(range(-2, 3), repeat=3) if d > (0, 0, 0)]
LEAF_PAIRS = 4_096  # pairs of boxes with at most this many pairs of places are compared place by place
SPLIT, LAST_LEVEL = 4, 15  # boxes split in SPLIT parts an axis each round; a box of the last level is below a micrometre


def chord(eps_m: float) -> float:
    """Straight distance of two points ``eps_m`` apart on the sphere."""
    return 2.0 * EARTH_R * math.sin(min(eps_m / (2.0 * EARTH_R), math.pi / 2))


def _cells(side: float, divide: int = 1) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(side / divide)).cast("long").alias(f"c{a}") for a in AXES]


def _gap(a: str, b: str) -> Column:
    """Squared distance of two points given as ``x, y, z`` with suffixes."""
    parts = [(F.col(f"{c}{a}") - F.col(f"{c}{b}")) * (F.col(f"{c}{a}") - F.col(f"{c}{b}")) for c in AXES]
    return parts[0] + parts[1] + parts[2]


def places(stores: DataFrame, side: float) -> DataFrame:
    """``place`` (smallest store id there), group, ``lat, lng, x, y, z``, ``n`` stores and cube of every different point."""
    rad = lambda c: F.col(c) * F.lit(math.pi) / F.lit(180.0)
    r = F.lit(EARTH_R)
    points = located(stores).groupBy("grp", "lat", "lng").agg(F.min("id").alias("place"), F.count(F.lit(1)).alias("n")) \
        .withColumn("x", r * F.cos(rad("lat")) * F.cos(rad("lng"))).withColumn("y", r * F.cos(rad("lat")) * F.sin(rad("lng"))) \
        .withColumn("z", r * F.sin(rad("lat")))
    return points.withColumn("cell", F.struct("grp", *_cells(side)))


def located(stores: DataFrame) -> DataFrame:
    on_earth = F.col("lat").between(-90.0, 90.0) & F.col("lng").between(-180.0, 180.0)
    return stores.filter(on_earth).select("id", "sector", F.coalesce("sector", F.lit("")).alias("grp"), "lat", "lng")


def near_cells(cells: DataFrame) -> DataFrame:
    """``a, b, wa, wb`` of occupied cubes near enough to hold stores within eps, each pair once."""
    offsets = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o)]) for o in HALF_OFFSETS])
    moved = F.struct(F.col("a.grp").alias("grp"), *[(F.col(f"a.c{c}") + F.col(f"d{c}")).alias(f"c{c}") for c in AXES])
    probes = cells.select(F.col("cell").alias("a"), F.col("w").alias("wa"), F.inline(offsets)).select("a", "wa", moved.alias("b"))
    return probes.join(cells.select(F.col("cell").alias("b"), F.col("w").alias("wb")), "b").select("a", "b", "wa", "wb")


def _on_cells(rows: DataFrame, spots: DataFrame, key: list[str], row_hash: str, plan: JoinPlan) -> DataFrame:
    """``rows`` joined to the places (``spots``, with an ``id``) of their cube, hot cubes salted."""
    return salted_join(rows, spots, plan.hot_rows, key, plan.hot_pairs, site_hash=row_hash)


def thin_neighbours(spots: DataFrame, cells: DataFrame, pairs: DataFrame, reach: float, min_points: int, plan: JoinPlan) -> DataFrame:
    """For every place ``p`` of a thin cube and cube ``b`` around with stores within reach: how many
    stores (``near``) and, of a thin ``b``, which places (``qs``, fewer than ``min_points``)."""
    thin = _on_cells(cells.filter(F.col("w") < min_points).select("cell", "w"), spots, ["cell"], "w", plan) \
        .select(F.col("id").alias("p"), F.col("cell").alias("a"), "w", *[F.col(c).alias(f"{c}p") for c in AXES])
    around = pairs.select("a", F.col("b").alias("cell"), "wb").union(pairs.select("b", "a", "wa"))
    probes = thin.join(around, "a")
    met = _on_cells(probes, spots, ["cell"], "p", plan).filter(_gap("p", "") <= F.lit(reach * reach))
    return met.groupBy("p", "a", "w", F.col("cell").alias("b"), "wb").agg(
        F.sum("n").alias("near"), F.collect_list(F.when(F.col("wb") < min_points, F.col("id"))).alias("qs"))


def _bounds(a: str, b: str) -> tuple[Column, Column]:
    """Squared least and greatest distance of the points of two boxes."""
    low, high = F.lit(0.0), F.lit(0.0)
    for c in AXES:
        apart = F.greatest(F.lit(0.0), F.col(f"lo{c}{a}") - F.col(f"hi{c}{b}"), F.col(f"lo{c}{b}") - F.col(f"hi{c}{a}"))
        over = F.greatest(F.col(f"hi{c}{a}") - F.col(f"lo{c}{b}"), F.col(f"hi{c}{b}") - F.col(f"lo{c}{a}"))
        low, high = low + apart * apart, high + over * over
    return low, high


def dense_links(spots: DataFrame, pairs: DataFrame, reach: float, side: float, plan: JoinPlan = DEFAULT_PLAN,
                leaf_pairs: int = LEAF_PAIRS) -> list[DataFrame]:
    """``a, b`` of the pairs of dense cubes that hold places within reach of each other."""
    still = checkpoint(pairs.select("a", "b", F.lit(None).cast("struct<cx:bigint,cy:bigint,cz:bigint>").alias("ka"),
                                    F.lit(None).cast("struct<cx:bigint,cy:bigint,cz:bigint>").alias("kb")))
    links, level = [], 0
    limit = F.lit(reach * reach)
    while still.limit(1).count():
        level += 1
        cells = still.select(F.col("a").alias("cell")).union(still.select("b")).distinct().withColumn("one", F.lit(1))
        inside = _on_cells(cells, spots, ["cell"], "one", plan) \
            .withColumn("k", F.struct(*_cells(side, SPLIT ** level))) \
            .withColumn("up", F.struct(*_cells(side, SPLIT ** (level - 1))) if level > 1 else F.lit(0))
        edges = [f(c).alias(f"{n}{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))]
        boxes = checkpoint(inside.groupBy("cell", "up", "k").agg(F.count(F.lit(1)).alias("m"), *edges))

        def one(s: str) -> DataFrame:
            return boxes.select(F.col("cell").alias(s), F.col("up").alias(f"up{s}"), F.col("k").alias(f"n{s}"),
                                *[F.col(c).alias(f"{c}{s}") for c in boxes.columns if c not in ("cell", "up", "k")])

        up = (lambda s: F.col(f"k{s}")) if level > 1 else (lambda s: F.lit(0))
        low, high = _bounds("a", "b")
        met = still.withColumn("upa", up("a")).withColumn("upb", up("b")).join(one("a"), ["a", "upa"]).join(one("b"), ["b", "upb"]) \
            .filter(low <= limit).select("a", "b", F.col("na").alias("ka"), F.col("nb").alias("kb"), (high <= limit).alias("linked"),
                                         ((F.col("ma") * F.col("mb") <= leaf_pairs) | F.lit(level >= LAST_LEVEL)).alias("small"))
        met = checkpoint(met)
        sure = met.filter("linked").select("a", "b").distinct()
        rest = met.filter("not linked").join(sure, ["a", "b"], "left_anti")

        def points(s: str) -> DataFrame:
            return inside.select(F.col("cell").alias(s), F.col("k").alias(f"k{s}"), *[F.col(c).alias(f"{c}{s}") for c in AXES])

        close = rest.filter("small").join(points("a"), ["a", "ka"]).join(points("b"), ["b", "kb"]) \
            .filter(_gap("a", "b") <= limit).select("a", "b").distinct()
        links.append(checkpoint(sure.union(close)))
        still = checkpoint(rest.filter("not small").select("a", "b", "ka", "kb").join(links[-1], ["a", "b"], "left_anti"))
    return links


def density_clusters(stores: DataFrame, eps_m: float = 300.0, min_points: int = 6, plan: JoinPlan = DEFAULT_PLAN,
                     leaf_pairs: int = LEAF_PAIRS) -> DataFrame:
    """``id, sector, role, cluster`` of every located store; ``cluster`` is null for noise."""
    reach = chord(eps_m)
    side = reach / math.sqrt(3.0) * (1.0 - 1e-9)
    stores = checkpoint(located(stores).drop("grp"))  # read three times
    points = checkpoint(places(stores, side))
    spots = points.select(F.col("place").alias("id"), "cell", "n", *AXES)
    cells = checkpoint(spots.groupBy("cell").agg(F.sum("n").alias("w"), F.min("id").alias("first")))
    pairs = checkpoint(near_cells(cells))
    near = checkpoint(thin_neighbours(spots, cells, pairs, reach, min_points, plan))
    core = checkpoint(near.groupBy("p", "a", "w").agg(F.sum("near").alias("near"))
                      .filter(F.col("near") + F.col("w") >= min_points).select("p", "a"))
    is_core = lambda name: core.select(F.col("p").alias(name), F.lit(True).alias(f"{name}_core"))
    touches = near.select("p", "a", "b", "wb", F.explode_outer("qs").alias("q")).join(is_core("q"), "q", "left") \
        .filter((F.col("wb") >= min_points) | F.col("q_core")).join(is_core("p"), "p", "left")
    touches = checkpoint(touches.select("p", "a", "b", F.coalesce("p_core", F.lit(False)).alias("p_core")).distinct())
    links = touches.filter("p_core").select("a", "b")
    both = pairs.filter((F.col("wa") >= min_points) & (F.col("wb") >= min_points))
    for found in dense_links(spots, both, reach, side, plan, leaf_pairs):
        links = links.union(found)
    roots = components(links)
    firsts = cells.filter(F.col("w") >= min_points).select("cell", "first", F.lit(True).alias("dense")) \
        .union(core.groupBy(F.col("a").alias("cell")).agg(F.min("p").alias("first")).withColumn("dense", F.lit(False)))
    rooted = firsts.join(roots.withColumnRenamed("node", "cell"), "cell", "left").withColumn("root", F.coalesce("root", "cell"))
    names = rooted.groupBy("root").agg(F.min("first").alias("cluster"))
    labels = checkpoint(rooted.join(names, "root").select("cell", "dense", "cluster"))
    own = _on_cells(labels, spots, ["cell"], "cluster", plan).select(F.col("id").alias("place"), "dense", "cluster") \
        .join(core.select(F.col("p").alias("place"), F.lit(True).alias("thin_core")), "place", "left") \
        .select("place", "cluster", (F.col("dense") | F.coalesce("thin_core", F.lit(False))).alias("core"))
    border = touches.filter("not p_core").join(labels.select(F.col("cell").alias("b"), "cluster"), "b") \
        .select(F.col("p").alias("place"), "cluster", F.lit(False).alias("core"))
    judged = own.union(border).groupBy("place").agg(F.min("cluster").alias("cluster"), F.max("core").alias("core"))
    role = F.when(F.col("core"), "core").when(F.col("cluster").isNotNull(), "border").otherwise("noise")
    told = points.select("grp", "lat", "lng", "place").join(judged, "place", "left") \
        .select("grp", "lat", "lng", "place", "cluster", role.alias("role"))
    return salted_join(told, located(stores), plan.hot_rows, ["grp", "lat", "lng"], plan.hot_pairs, site_hash="place") \
        .select("id", "sector", "role", "cluster")


def cluster_summary(stores: DataFrame, eps_m: float = 300.0, min_points: int = 6, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """One row per cluster: its sector, core and border stores."""
    n = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0)).cast("long")
    return density_clusters(stores, eps_m, min_points, plan).filter("cluster is not null").groupBy("sector", "cluster") \
        .agg(n("core").alias("n_core"), n("border").alias("n_border"), F.count(F.lit(1)).alias("n_stores"))
