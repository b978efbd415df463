"""Stores around every site: counts, newest-first lists, sorted pages.

Neither counts nor lists look at every pair within the radius: totals are sums
over circles (``circles.circle_sums``), lists the first ``k`` stores of a circle
(``circles.circle_first``), each cell of the grid giving about ``k`` rows a
site, of which ``row_number() <= k`` takes the list.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.functions.numeric import round_half_up
from sitelens.operators.circles import circle_first, circle_sums, located, written
from sitelens.operators.distance_join import prepare_sites

LIST_LIMIT = 100
# Most rows that sites want together before they are taken in parts, each part's shuffle files given back.
MAX_PART_ROWS = 100_000_000
# Column of a store row's own number (ids may repeat or be null).
REF = "_store_row"

# Sort options of the paged list (name -> order keys); the
# store id is appended as the final tie-break.  DESC puts NULLs first and
# ASC puts them last, as the original database did.
SORTS: dict[str, list[tuple[str, str]]] = {
    "distance_asc": [("distance_m", "asc")],
    "distance_desc": [("distance_m", "desc")],
    "open_date_desc": [("open_date", "desc")],
    "open_date_asc": [("open_date", "asc")],
    "sector_asc": [("sector", "asc"), ("open_date", "desc")],
}


def _order(keys: list[tuple[str, str]]) -> list[Column]:
    cols = [F.col(c).desc_nulls_first() if d == "desc" else F.col(c).asc_nulls_last() for c, d in keys]
    return cols + [F.col("id").asc()]


def _shape(df: DataFrame) -> list[Column]:
    """Row shaping of the list outputs: id as text, missing name as ''."""
    return [F.col("id").cast("string").alias("id"),
            F.coalesce(F.col("store_name"), F.lit("")).alias("store_name"),
            "sector", "address",
            geo.geojson_build(F.col("lat"), F.col("lng")).alias("location")]


def _counted(s: DataFrame, stores: DataFrame, stored: bool = False) -> DataFrame:
    """Site columns and ``n``: parts of the number of stores in every circle."""
    return circle_sums(s, stores, {"n": ("spheroid", F.lit(1))}, stored=stored)


def _count_per_site(s: DataFrame, stores: DataFrame, cols: list[str], stored: bool = False) -> DataFrame:
    """A zero row per site keeps sites without any store, in one aggregation."""
    both = _counted(s, stores, stored).select(*cols, "n").unionByName(s.select(*cols, F.lit(0).cast("long").alias("n")))
    return both.groupBy(*cols).agg(F.sum("n").alias("total_count"))


def competition_count(sites: DataFrame, stores: DataFrame, stored: bool = False) -> DataFrame:
    """Stores of the site's sector within the radius (spheroid metric);
    sites with none get 0.  ``stored``: the stores come from ``circles.located``."""
    s = prepare_sites(sites)
    c = _count_per_site(s, stores, ["site_id", "site_sector"], stored)
    return c.select("site_id", F.col("site_sector").alias("sector"), F.col("total_count").cast("long").alias("total_count"))


def _first_rows(s: DataFrame, stores: DataFrame, sort: str, k: int, stored: bool = False) -> DataFrame:
    """Pairs within the radius, among them the first ``k`` of every site in the sort order: site, store id, what
    the order needs and the distance (and ``REF``, if the stores have it)."""
    keys = SORTS[sort]
    names = [name for name, _ in keys if name != "distance_m"]
    shown = ["id", *names, *[c for c in stores.columns if c == REF]]
    stores = stores.select(*dict.fromkeys([*shown, "lat", "lng", "sector"]))
    if not names:
        return circle_first(s, stores, k, farthest=keys[0][1] == "desc", stored=stored).select("site_id", *shown, "distance_m")
    order = []
    for name, direction in keys:
        if name == "sector":
            order += [F.col(name).isNull().cast("int"), F.coalesce(F.col(name), F.lit(""))]
        else:  # a day's number; without a date first when descending, last when ascending
            day = F.unix_date(name).cast("long")
            order.append(F.coalesce(-day, F.lit(-(1 << 40))) if direction == "desc" else F.coalesce(day, F.lit(1 << 40)))
    return circle_first(s, stores, k, order, stored=stored).select("site_id", *shown, "distance_m")


def _with_ref(stores: DataFrame) -> DataFrame:
    """Located stores, written once, each row with a number of its own: pairs carry it instead of the store's texts,
    which only the rows shown get back."""
    cols = ["id", "store_name", "sector", "address", "open_date", "lat", "lng"]
    return located(stores.select(*cols, F.monotonically_increasing_id().alias(REF)))


def _ranked(pairs: DataFrame, sort: str, lo: int, hi: int) -> DataFrame:
    """Rows ``lo`` + 1 to ``hi`` of every site: site, ``rn``, ``REF``, distance."""
    w = Window.partitionBy("site_id").orderBy(*_order(SORTS[sort]))
    ranked = pairs.withColumn("rn", F.row_number().over(w)).filter((F.col("rn") <= hi) & (F.col("rn") > lo))
    return ranked.select("site_id", F.col("rn").cast("long").alias("rn"), REF, "distance_m")


def _parts(s: DataFrame, k: int) -> list[DataFrame]:
    """Prepared sites in parts that want ``MAX_PART_ROWS`` rows together, ``k`` each; the rows of a site stay together."""
    n = math.ceil(s.count() * k / MAX_PART_ROWS)
    return [s] if n <= 1 else [s.filter(F.pmod(F.xxhash64("site_id"), F.lit(n)) == i) for i in range(n)]


def _gathered(parts: list[DataFrame], rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows_of`` every part; those of several parts are written, so that the pairs of one part at a time lie on disk."""
    if len(parts) == 1:
        return rows_of(parts[0])
    name = f"rows-{uuid.uuid4().hex}"
    for part in parts:
        rows = written(rows_of(part), name, partial=True)
    return rows


def radius_list(sites: DataFrame, stores: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Newest ``limit`` stores within the radius of each site (optional
    sector), ranked by opening date desc (NULL first), then id."""
    st = _with_ref(stores)
    rows = _gathered(_parts(prepare_sites(sites), limit), lambda part: _ranked(
        _first_rows(part, st, "open_date_desc", limit, stored=True), "open_date_desc", 0, limit).drop("distance_m"))
    rows = rows.join(st, REF)
    return rows.select("site_id", "rn", *_shape(rows))


def _meta(total: Column, page: int, page_size: int) -> list[Column]:
    pages = F.ceil(total / F.lit(float(page_size))).cast("long")
    return [F.lit(page).cast("long").alias("page"), F.lit(page_size).cast("long").alias("page_size"),
            pages.alias("total_pages"), (F.lit(page) < pages).alias("has_next"),
            F.lit(page > 1).alias("has_prev")]


def radius_page(sites: DataFrame, stores: DataFrame, sort: str = "open_date_desc", page: int = 1,
                page_size: int = 20) -> DataFrame:
    """One page of the sorted list per site, with distance (2 decimals) and
    the paging totals of that site."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort!r}; one of {sorted(SORTS)}")
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    s = prepare_sites(sites)
    lo, hi = (page - 1) * page_size, page * page_size
    st = _with_ref(stores)
    totals, parts = _counted(s, st, stored=True).groupBy("site_id").agg(F.sum("n").alias("total_count")), _parts(s, hi)
    totals = totals if len(parts) == 1 else written(totals)
    # Totals first: both sides lie by site already, and rows are still narrow.
    rows = _gathered(parts, lambda part: _ranked(_first_rows(part, st, sort, hi, stored=True), sort, lo, hi).join(totals, "site_id"))
    rows = rows.join(st, REF)
    return rows.select("site_id", "rn", *_shape(rows), "open_date", round_half_up(F.col("distance_m")).alias("distance_m"),
                       "total_count", *_meta(F.col("total_count"), page, page_size))


def radius_page_meta(sites: DataFrame, stores: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """Paging totals for every site, including sites with no store (0)."""
    s = prepare_sites(sites)
    t = _count_per_site(s, stores, ["site_id"]).withColumn("total_count", F.col("total_count").cast("long"))
    return t.select("site_id", "total_count", *_meta(F.col("total_count"), page, page_size))
