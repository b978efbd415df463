"""Spatial patterns: dense-area clusters (X5), market competition index
(X10) and market potential from nearby closed stores (X11).

Dense cells: grid cells holding at least ``factor`` times the mean count of
occupied cells.  Clusters are 8-neighbour connected components of dense
cells, found by min-label propagation: each round every dense cell sends
its label to its (at most 9) neighbour positions and keeps the minimum it
receives -- 9 messages per cell, never all pairs of a group.  Rounds repeat
until no label changes; the label table is checkpointed every round so the
lineage stays one round long.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.numeric import round_half_up
from sitelens.operators import nearby
from sitelens.operators.circles import circle_sums, located
from sitelens.operators.distance_join import prepare_sites
from sitelens.operators.survival import survival_by_sector
from sitelens.operators.components import components
from sitelens.sources.tables import attach_one_row


def dense_cells(stores: DataFrame, grid_deg: float = 0.005, factor: float = 1.25,
                sector: str | None = None) -> DataFrame:
    s = stores.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    if sector:
        s = s.filter(F.col("sector") == F.lit(sector))
    cells = s.groupBy(F.floor(F.col("lng") / F.lit(grid_deg)).cast("long").alias("cx"),
                      F.floor(F.col("lat") / F.lit(grid_deg)).cast("long").alias("cy")) \
             .agg(F.count(F.lit(1)).alias("n"))
    mean = cells.agg(F.avg("n").alias("mean_n"))
    return attach_one_row(cells, mean).filter(F.col("n") >= F.lit(factor) * F.col("mean_n")) \
                .select("cx", "cy", "n")


def connected_cells(cells: DataFrame) -> DataFrame:
    """``cx, cy, n, cluster``: cluster = smallest cell key of the component
    (cells touching at a side or corner).  Rounds grow with the logarithm of
    a cluster's size (see ``operators.components``)."""
    key = (F.col("cx") * F.lit(1 << 32) + F.col("cy")).cast("long")
    keyed = cells.select("cx", "cy", "n", key.alias("key"))
    # Half of the neighbours: every touching pair is met once.
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (1, 1), (0, 1), (-1, 1))])
    probes = keyed.select("key", "cx", "cy", F.inline(offsets)) \
        .select(F.col("key").alias("a"), (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    touching = probes.join(keyed.select("cx", "cy", F.col("key").alias("b")), ["cx", "cy"]).select("a", "b")
    roots = components(touching).withColumnRenamed("node", "key")
    rooted = keyed.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = rooted.groupBy("root").agg(F.min("key").alias("cluster"))
    return rooted.join(named, "root").select("cx", "cy", "n", "cluster")


def dense_clusters(stores: DataFrame, grid_deg: float = 0.005, factor: float = 1.25,
                   sector: str | None = None) -> DataFrame:
    """One row per cluster -- cells, stores, bounding box in degrees."""
    cc = connected_cells(dense_cells(stores, grid_deg, factor, sector))
    g = F.lit(grid_deg)
    return cc.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_stores"),
        (F.min("cy") * g).alias("min_lat"), ((F.max("cy") + 1) * g).alias("max_lat"),
        (F.min("cx") * g).alias("min_lng"), ((F.max("cx") + 1) * g).alias("max_lng"))


def competition_index(sites: DataFrame, stores: DataFrame) -> DataFrame:
    """Same-sector stores per km2 within the site's radius divided by
    the sector's density over the box of all located stores (1 = average;
    sites without a sector compare with all stores)."""
    # The stores are derived once, and the box and all totals come from one row a sector.
    placed = located(stores.select("id", "sector", "lat", "lng"))
    by_sector = placed.groupBy("sector").agg(F.count(F.lit(1)).alias("n_sector"), F.min("lat").alias("la0"), F.max("lat").alias("la1"),
                                             F.min("lng").alias("lo0"), F.max("lng").alias("lo1")).checkpoint()
    box = by_sector.agg(F.min("la0").alias("la0"), F.max("la1").alias("la1"), F.min("lo0").alias("lo0"), F.max("lo1").alias("lo1"))
    km2 = ((F.col("la1") - F.col("la0")) * F.lit(111.32) * (F.col("lo1") - F.col("lo0")) * F.lit(111.32)
           * F.cos((F.col("la0") + F.col("la1")) * F.lit(0.5) * F.lit(math.pi) / F.lit(180.0)))
    box = box.select(km2.alias("box_km2"))
    per_sector = by_sector.select("sector", "n_sector")
    total = by_sector.agg(F.coalesce(F.sum("n_sector"), F.lit(0)).alias("n_total"))
    counts = nearby.competition_count(sites, placed, stored=True)
    c = attach_one_row(attach_one_row(
        counts.join(sites.select("site_id", "radius_m"), "site_id").join(per_sector, "sector", "left"), total), box)
    n_ref = F.coalesce(F.col("n_sector"), F.col("n_total")).cast("double")
    local = F.col("total_count") / (F.lit(math.pi) * F.col("radius_m") * F.col("radius_m") / F.lit(1e6))
    city = n_ref / F.col("box_km2")
    return c.select("site_id", "sector", "total_count",
                    round_half_up(F.when(city > 0, local / city), 4).alias("competition_index"))


def market_potential(sites: DataFrame, stores: DataFrame) -> DataFrame:
    """X11: mean lifetime (days) of closed stores of the site's sector within
    its radius, divided by the sector's mean (A1); NULL without closed
    neighbours."""
    closed = stores.filter(F.col("close_date").isNotNull() & F.col("open_date").isNotNull()
                           & (F.datediff("close_date", "open_date") >= 0))
    parts = circle_sums(prepare_sites(sites), closed, {"n": ("spheroid", F.lit(1)), "days": ("spheroid", F.datediff("close_date", "open_date"))})
    local = parts.groupBy("site_id").agg(F.sum("n").alias("n_closed"), F.sum("days").alias("days")) \
        .select("site_id", "n_closed", F.when(F.col("n_closed") > 0, F.col("days") / F.col("n_closed")).alias("local_avg"))
    ref = survival_by_sector(stores).select("sector", F.col("avg_duration_days").alias("sector_avg"))
    s = sites.select("site_id", "sector").join(local, "site_id", "left").join(ref, "sector", "left")
    return s.select("site_id", "sector", F.coalesce("n_closed", F.lit(0)).cast("long").alias("n_closed"),
                    round_half_up(F.col("local_avg")).alias("local_avg_days"), "sector_avg",
                    round_half_up(F.when(F.col("sector_avg") > 0, F.col("local_avg") / F.col("sector_avg")), 4)
                    .alias("potential"))


def sector_colocation(stores: DataFrame, grid_deg: float = 0.01) -> DataFrame:
    """For every pair of sectors, the correlation of their store counts
    over occupied grid cells and the number of cells holding both.

    From the (cell, sector) counts: sums and squares per sector, products of
    the sectors that share a cell (at most sectors squared per cell, never
    stores), and the number of occupied cells, through which the empty cells
    of a sector enter.
    """
    located = stores.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("sector").isNotNull())
    cells = located.groupBy(F.floor(F.col("lat") / F.lit(grid_deg)).cast("long").alias("cy"),
                            F.floor(F.col("lng") / F.lit(grid_deg)).cast("long").alias("cx"), "sector") \
                   .agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = cells.groupBy("sector").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    one = lambda side: cells.select("cy", "cx", F.col("sector").alias(f"sector_{side}"), F.col("n").alias(f"n_{side}"))
    both = one("a").join(one("b"), ["cy", "cx"]).filter(F.col("sector_a") < F.col("sector_b")) \
        .groupBy("sector_a", "sector_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("p"), F.count(F.lit(1)).alias("cells_both"))
    names = sums.agg(F.collect_set("sector").alias("names"))
    pairs = attach_one_row(sums.select(F.col("sector").alias("sector_a"), F.col("s").alias("sa"), F.col("q").alias("qa")), names) \
        .select("sector_a", "sa", "qa", F.explode("names").alias("sector_b")).filter(F.col("sector_a") < F.col("sector_b")) \
        .join(sums.select(F.col("sector").alias("sector_b"), F.col("s").alias("sb"), F.col("q").alias("qb")), "sector_b") \
        .join(both, ["sector_a", "sector_b"], "left")
    n_cells = cells.select("cy", "cx").distinct().agg(F.count(F.lit(1)).alias("m"))
    m, p = F.col("m"), F.coalesce("p", F.lit(0.0))
    spread = (m * F.col("qa") - F.col("sa") * F.col("sa")) * (m * F.col("qb") - F.col("sb") * F.col("sb"))
    corr = F.when(spread > 0, (m * p - F.col("sa") * F.col("sb")) / F.sqrt(spread))
    return attach_one_row(pairs, n_cells).select("sector_a", "sector_b", round_half_up(corr, 6).alias("corr"),
                                                 F.coalesce("cells_both", F.lit(0)).cast("long").alias("cells_both"))
