"""Spatial pattern of store counts over grid cells (X12): global and local Moran statistic.

Cells are those that hold a located store; two cells are neighbours (weight 1)
when they touch at a side or corner.  Values near +1 mean that crowded cells lie
beside crowded ones, near 0 no pattern, below 0 a chequerboard.

Everything is built from cell counts, partially aggregated and stored once:
a cell meets its at most eight neighbours, stores never meet.  A sector's empty
cells are not written out; they enter through the cell and neighbour totals.
Sums are whole numbers, so the result does not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.numeric import round_half_up
from sitelens.operators.components import checkpoint
from sitelens.sources.tables import attach_one_row

AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def cell_counts(stores: DataFrame, grid_deg: float) -> DataFrame:
    """``cx, cy, sector, n`` of the located stores."""
    return checkpoint(stores.filter("lat is not null and lng is not null").groupBy(
        F.floor(F.col("lng") / F.lit(grid_deg)).cast("long").alias("cx"),
        F.floor(F.col("lat") / F.lit(grid_deg)).cast("long").alias("cy"), "sector").agg(F.count(F.lit(1)).alias("n")))


def neighbour_sums(cells: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ``cx, cy, n`` with ``deg`` neighbours (of the same key) and ``lag``, the sum of their counts."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in AROUND])
    sent = cells.select(*key, "cx", "cy", "n", F.inline(offsets)) \
        .select(*key, (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), F.col("n").alias("from_n"))
    place = [*key, "cx", "cy"]
    got = sent.join(cells.select(*place), place, "left_semi").groupBy(*place).agg(
        F.count(F.lit(1)).alias("deg"), F.sum("from_n").alias("lag"))
    zero = F.lit(0).cast("long")
    return cells.select(*place, "n").join(got, place, "left") \
        .withColumn("deg", F.coalesce("deg", zero)).withColumn("lag", F.coalesce("lag", zero))


def sector_moran(stores: DataFrame, grid_deg: float = 0.01) -> DataFrame:
    """Global statistic of every sector over all occupied cells; null where all cells hold as many or none touch.
    Stores without a sector count for the cells only."""
    per = cell_counts(stores, grid_deg)
    cells = neighbour_sums(per.groupBy("cx", "cy").agg(F.sum("n").alias("n")), [])
    totals = cells.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("deg").alias("links"))
    own = neighbour_sums(per.filter("sector is not null"), ["sector"]).drop("deg") \
        .join(cells.select("cx", "cy", "deg"), ["cx", "cy"])
    sums = own.groupBy("sector").agg(
        F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"),
        F.sum(F.col("deg") * F.col("n")).alias("d"), F.sum(F.col("n") * F.col("lag")).alias("c"))
    rows = attach_one_row(sums, totals).withColumn("mean", F.col("s") / F.col("n_cells"))
    spread = F.col("q") - F.col("s") * F.col("mean")
    cross = F.col("c") - F.lit(2.0) * F.col("mean") * F.col("d") + F.col("mean") * F.col("mean") * F.col("links")
    moran = F.when((spread > 0) & (F.col("links") > 0), F.col("n_cells") / F.col("links") * cross / spread)
    return rows.select("sector", F.col("s").alias("n_stores"), "n_cells", round_half_up(moran, 6).alias("moran"))


def local_moran(stores: DataFrame, grid_deg: float = 0.01) -> DataFrame:
    """Local statistic of every occupied cell for all stores, and its kind: ``HH`` crowded among crowded, ``LL``
    sparse among sparse, ``HL`` / ``LH`` unlike their neighbours; null without neighbours or spread."""
    cells = checkpoint(neighbour_sums(cell_counts(stores, grid_deg).groupBy("cx", "cy").agg(F.sum("n").alias("n")), []))
    totals = cells.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    rows = attach_one_row(cells, totals).withColumn("mean", F.col("s") / F.col("n_cells"))
    rows = rows.withColumn("z", F.col("n") - F.col("mean")).withColumn("zlag", F.col("lag") - F.col("deg") * F.col("mean")) \
        .withColumn("m2", (F.col("q") - F.col("s") * F.col("mean")) / F.col("n_cells"))
    known = (F.col("deg") > 0) & (F.col("m2") > 0)
    kind = F.concat(F.when(F.col("z") > 0, "H").otherwise("L"), F.when(F.col("zlag") > 0, "H").otherwise("L"))
    return rows.select("cx", "cy", "n", F.col("deg").alias("n_neighbours"),
                       round_half_up(F.when(known, F.col("z") * F.col("zlag") / F.col("m2")), 6).alias("local_moran"),
                       F.when(known, kind).alias("kind"))
