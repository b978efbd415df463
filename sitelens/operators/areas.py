"""Area statistics.

Areas are grid cells or the address (district) text; every statistic is a
grouped aggregate with map-side partial aggregation.  Shares use a window
over the already-aggregated (area, sector) rows, never over raw stores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.numeric import round_half_up
from sitelens.sources.tables import attach_one_row

KM_PER_DEG = 111.32


def _cell(c: str, g: float) -> Column:
    return F.floor(F.col(c) / F.lit(g)).cast("long")


def grid_density(stores: DataFrame, grid_deg: float = 0.01, by_sector: bool = True) -> DataFrame:
    """Stores per grid cell (and sector) with the cell area in km2 and
    the density per km2."""
    keys = [_cell("lat", grid_deg).alias("cell_lat"), _cell("lng", grid_deg).alias("cell_lng")]
    if by_sector:
        keys.append(F.col("sector"))
    agg = stores.filter(F.col("lat").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    mid_lat = (F.col("cell_lat") + F.lit(0.5)) * F.lit(grid_deg)
    area = F.lit(grid_deg * KM_PER_DEG) * F.lit(grid_deg * KM_PER_DEG) * F.cos(mid_lat * F.lit(math.pi) / F.lit(180.0))
    return agg.select("*", round_half_up(area, 6).alias("area_km2"),
                      round_half_up(F.col("n") / area, 6).alias("density"))


def sector_share(stores: DataFrame, area_col: str = "address") -> DataFrame:
    """Stores per (area, sector) and the sector's percent of the area."""
    counts = stores.groupBy(area_col, "sector").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(area_col))
    return counts.select(area_col, "sector", "n", round_half_up(F.col("n") / total * F.lit(100.0)).alias("share_pct"))


def area_stats(stores: DataFrame, area_col: str = "address") -> DataFrame:
    """Per area -- stores, open stores, distinct sectors, mean opening date."""
    mean_day = F.floor(F.avg(F.unix_date("open_date"))).cast("int")
    return stores.groupBy(area_col).agg(
        F.count(F.lit(1)).alias("n_stores"),
        F.count_if(F.col("close_date").isNull()).alias("n_open"),
        F.count_distinct("sector").alias("n_sectors"),
        F.date_from_unix_date(mean_day).alias("mean_open_date"))


def district_rollup(stores: DataFrame) -> DataFrame:
    """Counts by the first three address tokens (city / district /
    neighbourhood) with subtotals at every level (ROLLUP)."""
    toks = F.split(F.trim(F.col("address")), r"\s+")
    t = stores.select(F.element_at(toks, 1).alias("si"),
                      F.when(F.size(toks) >= 2, F.element_at(toks, 2)).alias("gu"),
                      F.when(F.size(toks) >= 3, F.element_at(toks, 3)).alias("dong"))
    return t.rollup("si", "gu", "dong").agg(F.count(F.lit(1)).alias("n"),
                                            F.grouping_id().cast("long").alias("level"))


def dispersion(stores: DataFrame, grid_deg: float = 0.01) -> DataFrame:
    """Per sector, variance-to-mean ratio of store counts over all grid
    cells of the sector's bounding box (empty cells count as 0): about 1 for
    random placement, above 1 for clustering.  Computed from occupied cells
    only: sum n, sum n^2 and the box's cell count."""
    cells = stores.filter(F.col("lat").isNotNull() & F.col("sector").isNotNull()) \
        .groupBy("sector", _cell("lat", grid_deg).alias("cy"), _cell("lng", grid_deg).alias("cx")) \
        .agg(F.count(F.lit(1)).alias("n"))
    s = cells.groupBy("sector").agg(
        F.sum("n").alias("n_stores"), F.sum(F.col("n") * F.col("n")).alias("sum_sq"),
        F.count(F.lit(1)).alias("occupied_cells"),
        ((F.max("cy") - F.min("cy") + 1) * (F.max("cx") - F.min("cx") + 1)).alias("box_cells"))
    mean = F.col("n_stores") / F.col("box_cells")
    var = F.col("sum_sq") / F.col("box_cells") - mean * mean
    return s.select("sector", F.col("n_stores").cast("long").alias("n_stores"), "occupied_cells",
                    F.col("box_cells").cast("long").alias("box_cells"),
                    round_half_up(mean, 4).alias("mean_per_cell"),
                    round_half_up(F.when(mean > 0, var / mean), 4).alias("vmr"))


SEARCH_SORTS = {
    "newest": lambda: [F.col("open_date").desc_nulls_first(), F.col("id")],
    "oldest": lambda: [F.col("open_date").asc_nulls_last(), F.col("id")],
    "name": lambda: [F.col("store_name").asc_nulls_last(), F.col("id")],
    "address": lambda: [F.col("address").asc_nulls_last(), F.col("id")],
}


def search_page(stores: DataFrame, text: str | None = None, page: int = 1, page_size: int = 20,
                sector: str | None = None, sort: str = "newest") -> DataFrame:
    """name/address search (the text is literal, in any case) and sector
    filter, sorted, one page.  ``orderBy().limit`` keeps at most ``page *
    page_size`` rows before numbering them."""
    s = stores
    if text:
        wanted = F.lower(F.lit(text))
        s = s.filter(F.contains(F.lower("store_name"), wanted) | F.contains(F.lower("address"), wanted))
    if sector is not None and sector.strip():
        s = s.filter(F.col("sector") == sector)
    order = SEARCH_SORTS[sort]()
    top = s.orderBy(*order).limit(page * page_size)
    w = Window.orderBy(*order)
    return top.withColumn("rn", F.row_number().over(w).cast("long")) \
              .filter(F.col("rn") > (page - 1) * page_size)


def in_viewport(stores: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Stores inside a lat/lng box (a pushed-down range filter on a
    stored table)."""
    return stores.filter(F.col("lat").between(south, north) & F.col("lng").between(west, east))


def zoom_grid_deg(zoom: Column) -> Column:
    """Grid step by map zoom (>15 -> 0.005, >12 -> 0.01, else 0.02)."""
    return F.when(zoom > 15, 0.005).when(zoom > 12, 0.01).otherwise(0.02)


def local_xy(lat: Column, lng: Column, lat0, lng0) -> tuple[Column, Column]:
    """Metres east / north of (lat0, lng0) (floats or Columns),
    111 320 m per degree, longitude scaled by cos(lat0)."""
    lat0 = lat0 if isinstance(lat0, Column) else F.lit(float(lat0))
    lng0 = lng0 if isinstance(lng0, Column) else F.lit(float(lng0))
    x = (lng - lng0) * F.lit(111320.0) * F.cos(lat0 * F.lit(math.pi) / F.lit(180.0))
    y = (lat - lat0) * F.lit(111320.0)
    return x, y


def store_markers(stores: DataFrame, as_of, zoom: int = 14) -> DataFrame:
    """What a map layer needs per located store -- position in
    metres from the centre of all stores, bar height (years open, at most 3;
    0.5 without an opening date) and the grid cell at the zoom's step."""
    from sitelens.operators.scores import marker_height
    located = stores.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    centre = located.agg(((F.min("lat") + F.max("lat")) * F.lit(0.5)).alias("lat0"),
                         ((F.min("lng") + F.max("lng")) * F.lit(0.5)).alias("lng0"))
    t = attach_one_row(located, centre)
    x, y = local_xy(F.col("lat"), F.col("lng"), F.col("lat0"), F.col("lng0"))
    step = zoom_grid_deg(F.lit(zoom))
    return t.select("id", "sector", round_half_up(x).alias("x_m"), round_half_up(y).alias("y_m"),
                    round_half_up(marker_height(F.col("open_date"), as_of), 4).alias("height"),
                    step.alias("grid_deg"),
                    F.floor(F.col("lat") / step).cast("long").alias("cell_lat"),
                    F.floor(F.col("lng") / step).cast("long").alias("cell_lng"))
