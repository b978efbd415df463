"""Distance join: every (site, store) pair within the site's radius.

Catalyst cannot turn ``distance(a, b) <= r`` into an equi-join, so the
rewrite is done here at DataFrame level:

1. a multi-level grid: level ``L`` has square cells of ``GRID_LEVELS[L]``
   degrees.  Each store gets its cell ``(level, cx, cy)`` at every level;
2. each site picks ONE level whose cell is not much smaller than its circle and
   is exploded into the cells of that level its circle touches (a superset,
   so nothing is missed; a store has one cell per level, so nothing is
   duplicated).  Only levels that some circle picks are used;
3. equi-join on ``(level, cx, cy)``, a cheap bounding-box test, then the
   exact distance as a residual filter.

Physical strategy, chosen with checked sizes:

* **broadcast** the exploded site cells when their row count (the sum of
  rows x columns of the covering boxes, counted without exploding them) is at
  most ``broadcast_max_rows``; the store side then streams through a hash join
  in its scan partitions with no shuffle at all;
* otherwise a **salted shuffle join**: a cell with more than ``hot_rows``
  rows on a side, or with more than ``hot_pairs`` store x site pairs, has both
  sides hashed into salt buckets and each replicated to the other's buckets,
  so a join key holds at most about ``hot_pairs / 4`` pairs even when one cell
  holds a third of both tables.  The table of hot cells is broadcast only
  while its row count is checked to be at most ``broadcast_max_rows``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.sources.tables import has_at_most


# Cell sizes in degrees, coarsest first, of which a join uses those that its
# circles need.  City radii need the finest only (about 1.1 km of latitude): at
# 100 m - 2 km the bounding-box test already removes most candidates, and every
# extra level adds one store row per level.
GRID_LEVELS = (45.0, 10.0, 1.0, 0.1, 0.01)
# A circle takes the finest level whose cell is at least its half-height over
# MAX_ROWS and its half-width over MAX_COLS: wide circles and circles near a
# pole stay some hundred cells.
MAX_ROWS, MAX_COLS = 4, 16


@dataclass(frozen=True)
class JoinPlan:
    grid_levels: tuple[float, ...] = GRID_LEVELS
    max_rows: float = MAX_ROWS
    broadcast_max_rows: int = 2_000_000
    hot_rows: int = 1_000_000
    hot_pairs: int = 100_000_000
    # A store side of at most this many rows is spread round-robin over the
    # cluster before the broadcast join (a small table may sit in one file
    # split, i.e. one task); a larger one already has many scan splits.
    spread_max_rows: int = 50_000_000
    force: str | None = None  # "broadcast" | "salted" | None (size-checked)


DEFAULT_PLAN = JoinPlan()

SITE_COLS = ["site_id", "site_lat", "site_lng", "radius_m", "site_sector"]


def prepare_sites(sites: DataFrame) -> DataFrame:
    """``site_id, lat, lng, radius_m, sector`` -> prefixed site columns.  A
    blank sector is no filter, like a missing one."""
    return sites.select(F.col("site_id"), F.col("lat").alias("site_lat"), F.col("lng").alias("site_lng"),
                        F.col("radius_m").cast("double").alias("radius_m"),
                        F.nullif(F.trim("sector"), F.lit("")).alias("site_sector"))


def store_cells(stores: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Located stores, one row per grid level with that level's cell."""
    located = stores.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    lat, lng = F.col("lat"), F.col("lng")
    cells = F.array(*[F.struct(F.lit(i).alias("level"), geo.cell_x(lng, g).alias("cx"), geo.cell_y(lat, g).alias("cy"))
                      for i, g in enumerate(levels)])
    return located.withColumn("c", F.explode(cells)).select("*", "c.level", "c.cx", "c.cy").drop("c")


def usable_sites(sites: DataFrame) -> DataFrame:
    """Prepared sites that lie on Earth and have a radius; others match no store (``quality.rejected_sites`` lists them)."""
    return sites.filter(F.col("site_lat").between(-90.0, 90.0) & F.col("site_lng").between(-180.0, 180.0)
                        & (F.col("radius_m") >= 0) & (F.col("radius_m") < float("inf")))


def site_level(lat: Column, radius_m: Column, levels: tuple[float, ...], max_rows: float = MAX_ROWS) -> Column:
    """Index of the finest level whose cells are not too small for the circle (see ``MAX_ROWS``)."""
    need = F.greatest(geo.lat_reach_deg(radius_m) / max_rows, geo.lng_reach_deg(lat, radius_m) / MAX_COLS)
    out = F.lit(0)
    for i, g in enumerate(levels):
        out = F.when(need <= F.lit(g), F.lit(i)).otherwise(out)
    return out


def site_cells(sites: DataFrame, levels: tuple[float, ...], max_rows: float = MAX_ROWS) -> DataFrame:
    """Sites exploded to covering cells of their level, carrying the
    half-size in degrees of the circle's bounding box."""
    lat, lng, r = F.col("site_lat"), F.col("site_lng"), F.col("radius_m")
    size = F.element_at(F.array(*[F.lit(g) for g in levels]), F.col("level") + 1)
    return (sites
            .withColumn("reach_lat", geo.lat_reach_deg(r))
            .withColumn("reach_lng", geo.lng_reach_deg(lat, r))
            .withColumn("level", site_level(lat, r, levels, max_rows))
            .withColumn("cy", F.explode(geo.covering_rows(lat, r, size)))
            .withColumn("cx", F.explode(geo.covering_cols(lat, lng, r, size))))


KEY = ["level", "cx", "cy"]


def needed_levels(sites: DataFrame, levels: tuple[float, ...], max_rows: float = MAX_ROWS) -> tuple[tuple[float, ...], int]:
    """The levels that the circles need, and how many rows ``site_cells`` has: covering
    rows x columns per site, summed without exploding them."""
    lat, lng, r = F.col("site_lat"), F.col("site_lng"), F.col("radius_m")
    size = F.element_at(F.array(*[F.lit(g) for g in levels]), F.col("level") + 1)
    n = F.size(geo.covering_rows(lat, r, size)).cast("long") * F.size(geo.covering_cols(lat, lng, r, size))
    found = sites.withColumn("level", site_level(lat, r, levels, max_rows)).groupBy("level").agg(F.sum(n).alias("n")).collect()
    used = tuple(levels[i] for i in sorted(f["level"] for f in found))
    return used or levels[-1:], sum(f["n"] or 0 for f in found)


def salt_sides(sc: DataFrame, st: DataFrame, hot_rows: int, key: list[str], hot_pairs: int | None = None,
               max_broadcast_rows: int = 2_000_000, site_hash: str = "site_id") -> tuple[DataFrame, DataFrame]:
    """Both join sides with ``salt_a`` / ``salt_b``: the stores of a hot cell
    are hashed over ``nb`` buckets and each site cell is copied to all of
    them; symmetrically ``na`` for site cells.  Buckets hold half the allowed
    rows on average (head-room for hash fluctuation)."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))

    hot_pairs = hot_pairs or hot_rows * hot_rows
    cells = count(st, "n_st").join(count(sc, "n_sc"), key, "full")  # a crowded cell of one side is dealt out too
    crowded = F.col("n_st").cast("double") * F.col("n_sc") > F.lit(float(hot_pairs))
    side = F.when(crowded, F.lit(float(min(hot_rows, math.isqrt(hot_pairs))))).otherwise(F.lit(float(hot_rows)))
    buckets = lambda n: F.when(F.col(n) > side, F.ceil(F.col(n) * F.lit(2.0) / side)).otherwise(F.lit(1)).cast("int")
    hot_cells = cells.filter(crowded | (F.col("n_st") > F.lit(hot_rows)) | (F.col("n_sc") > F.lit(hot_rows))) \
        .select(*key, buckets("n_st").alias("nb"), buckets("n_sc").alias("na"))
    if has_at_most(hot_cells, max_broadcast_rows):
        hot_cells = F.broadcast(hot_cells)
    one = F.lit(1)
    st2 = (st.join(hot_cells, key, "left")
           .withColumn("nb", F.coalesce("nb", one)).withColumn("na", F.coalesce("na", one))
           .withColumn("salt_b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
           .withColumn("salt_a", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
           .drop("na", "nb"))
    sc2 = (sc.join(hot_cells, key, "left")
           .withColumn("nb", F.coalesce("nb", one)).withColumn("na", F.coalesce("na", one))
           .withColumn("salt_a", F.pmod(F.xxhash64(site_hash), F.col("na")).cast("int"))
           .withColumn("salt_b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
           .drop("na", "nb"))
    return st2, sc2


def salted_join(sc: DataFrame, st: DataFrame, hot_rows: int, key: list[str], hot_pairs: int | None = None,
                site_hash: str = "site_id") -> DataFrame:
    st2, sc2 = salt_sides(sc, st, hot_rows, key, hot_pairs, site_hash=site_hash)
    return st2.join(sc2, key + ["salt_a", "salt_b"]).drop("salt_a", "salt_b")


# Join-key value of "any sector" (a site without a sector filter).
ANY_SECTOR = "\u0000any"


def candidate_pairs(sites: DataFrame, stores: DataFrame, plan: JoinPlan = DEFAULT_PLAN,
                    by_sector: bool = False) -> DataFrame:
    """All (site, store) pairs sharing a cell and inside the circle's
    bounding box -- a superset of the pairs within the radius under either
    metric.  ``sites`` must be prepared.

    ``by_sector`` makes the optional sector filter part of the equi-join key:
    a store is keyed by its sector and by ``ANY_SECTOR``; a site by its
    sector, or ``ANY_SECTOR`` when it has none.  Sector sites then never see
    other sectors' stores (no distance is computed for them).
    """
    sites = usable_sites(sites)
    levels, n_cells = needed_levels(sites, plan.grid_levels, plan.max_rows)
    sc = site_cells(sites, levels, plan.max_rows)
    st = store_cells(stores, levels)
    key = list(KEY)
    if by_sector:
        sc = sc.withColumn("sk", F.coalesce(F.col("site_sector"), F.lit(ANY_SECTOR)))
        st = st.withColumn("sk", F.explode(F.array(F.col("sector"), F.lit(ANY_SECTOR))))
        key.append("sk")
    strategy = plan.force
    if strategy is None:
        strategy = "broadcast" if n_cells <= plan.broadcast_max_rows else "salted"
    if strategy == "broadcast":
        if has_at_most(stores.select("id"), plan.spread_max_rows):
            st = st.repartition(_parallelism(st))
        pairs = st.join(F.broadcast(sc), key)
    else:
        pairs = salted_join(sc, st, plan.hot_rows, key, plan.hot_pairs)
    # Cheap bounding-box test before any trigonometry: the box holds the
    # circle, so no pair within the radius is lost.
    dlng = F.abs(F.col("lng") - F.col("site_lng"))
    in_box = ((F.abs(F.col("lat") - F.col("site_lat")) <= F.col("reach_lat"))
              & ((dlng <= F.col("reach_lng")) | (F.lit(360.0) - dlng <= F.col("reach_lng"))))
    return pairs.filter(in_box).drop("level", "cx", "cy", "reach_lat", "reach_lng", "sk")


def _parallelism(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def sector_match(site_sector: Column, store_sector: Column) -> Column:
    """Optional-parameter predicate: a site without a sector matches all."""
    return site_sector.isNull() | (site_sector == store_sector)


def with_distances(pairs: DataFrame, **metrics: str) -> DataFrame:
    """Add distance columns (``name="spheroid"|"haversine"``) computed ONCE
    per candidate pair.

    The metric is computed as a chain of small projections (each sine and
    square root once per row).  The final distances come out of an
    ``inline`` generator: a later ``distance <= r`` filter refers to the
    generator's output and therefore stays above it.  Without that barrier
    Catalyst pushes the filter into the join condition with every step
    inlined, where the trigonometry is evaluated again, without shared
    subexpressions, in a method too large for the JIT compiler.
    """
    df = pairs
    temps: list[str] = []
    finals = []
    for name, metric in metrics.items():
        steps = geo.distance_steps(metric, f"_{name}_", "site_lat", "site_lng", "lat", "lng")
        for col_name, col in steps[:-1]:
            df = df.withColumn(col_name, col)
            temps.append(col_name)
        finals.append(steps[-1][1].alias(name))
    return df.select("*", F.inline(F.array(F.struct(*finals)))).drop(*temps)


def within_radius(sites: DataFrame, stores: DataFrame, metric: str = "spheroid",
                  match_sector: bool = True, plan: JoinPlan = DEFAULT_PLAN) -> DataFrame:
    """Pairs with ``distance_m <= radius_m`` (and the site's sector, if any,
    when ``match_sector``).  ``metric`` is ``spheroid``, ``haversine`` or ``global``."""
    pairs = with_distances(candidate_pairs(sites, stores, plan, by_sector=match_sector), distance_m=metric)
    return pairs.filter(F.col("distance_m") <= F.col("radius_m"))
