"""Stores in polygons (X1) and along routes.

Both reuse the grid: a shape (a polygon's bounding box, or one route
segment padded by the radius) is exploded into the 0.01-degree cells it
touches and equi-joined with the stores' cells -- broadcast only when the
shape cells are counted few in rows and bytes, else the salted shuffle join
that splits crowded cells.

* Polygon membership is the even-odd rule, decided in the candidate row: a
  ray to the east crosses the polygon's edges (``aggregate`` over the edge
  array) an odd number of times.  No shuffle, and equal store rows stay apart.
* Route distance is the planar point-to-segment distance in local metres
  (111 320 m per degree, longitude scaled by the cosine of the segment's
  mean latitude); a store near several segments keeps its minimum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.operators.distance_join import salted_join, store_cells

GRID = 0.01
M_PER_DEG = 111320.0


def _box_cells(df: DataFrame, lat0: Column, lat1: Column, lng0: Column, lng1: Column) -> DataFrame:
    rows = F.sequence(geo.cell_y(lat0, GRID), geo.cell_y(lat1, GRID))
    ncols = geo.n_cols(GRID)
    x0 = F.floor((lng0 + F.lit(180.0)) / F.lit(GRID)).cast("long")
    x1 = F.floor((lng1 + F.lit(180.0)) / F.lit(GRID)).cast("long")
    cols = F.array_distinct(F.transform(F.sequence(x0, F.least(x1, x0 + ncols - 1)), lambda x: F.pmod(x, ncols)))
    return df.withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(cols)).withColumn("level", F.lit(0))


MAX_BROADCAST_BYTES = 256_000_000
HOT_ROWS, HOT_PAIRS = 1_000_000, 100_000_000


def _join_cells(shape_cells: DataFrame, stores: DataFrame, max_broadcast_rows: int, shape_id: str,
                row_bytes: Column) -> DataFrame:
    st = store_cells(stores, (GRID,))
    key = ["level", "cx", "cy"]
    size = shape_cells.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes).alias("bytes")).first()
    if size["n"] <= max_broadcast_rows and (size["bytes"] or 0) <= MAX_BROADCAST_BYTES:
        return st.join(F.broadcast(shape_cells), key).drop(*key)
    return salted_join(shape_cells, st, HOT_ROWS, key, HOT_PAIRS, site_hash=shape_id).drop(*key)


def _edges(vertices: str) -> Column:
    """array<struct<alat,alng,blat,blng>> of a closed ring of vertices."""
    v = F.col(vertices)
    n = F.size(v)
    nxt = F.concat(F.slice(v, 2, n), F.slice(v, 1, 1))
    return F.transform(F.arrays_zip(v.alias("a"), nxt.alias("b")),
                       lambda e: F.struct(e["a"]["lat"].alias("alat"), e["a"]["lng"].alias("alng"),
                                          e["b"]["lat"].alias("blat"), e["b"]["lng"].alias("blng")))


def stores_in_polygons(polygons: DataFrame, stores: DataFrame, max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """``poly_id`` + store columns for every store inside a polygon
    (``polygons``: ``poly_id, vertices array<struct<lat double, lng double>>``)."""
    lat = F.transform("vertices", lambda p: p["lat"])
    lng = F.transform("vertices", lambda p: p["lng"])
    polys = polygons.select("poly_id", _edges("vertices").alias("edges"),
                            F.array_min(lat).alias("p_lat0"), F.array_max(lat).alias("p_lat1"),
                            F.array_min(lng).alias("p_lng0"), F.array_max(lng).alias("p_lng1"))
    cells = _box_cells(polys, F.col("p_lat0"), F.col("p_lat1"), F.col("p_lng0"), F.col("p_lng1"))
    cand = _join_cells(cells, stores, max_broadcast_rows, "poly_id", F.lit(64) + F.size("edges") * 40).filter(
        F.col("lat").between(F.col("p_lat0"), F.col("p_lat1")) & F.col("lng").between(F.col("p_lng0"), F.col("p_lng1")))

    def crossing(e: Column) -> Column:
        straddles = (e["alat"] > F.col("lat")) != (e["blat"] > F.col("lat"))
        x_at = (e["blng"] - e["alng"]) * (F.col("lat") - e["alat"]) / (e["blat"] - e["alat"]) + e["alng"]
        return F.when(straddles, F.when(F.col("lng") < x_at, 1).otherwise(0)).otherwise(0)

    crossings = F.aggregate("edges", F.lit(0), lambda n, e: n + crossing(e))
    return cand.filter(crossings % 2 == 1).select("poly_id", *stores.columns)


def polygon_sector_counts(polygons: DataFrame, stores: DataFrame) -> DataFrame:
    """Stores per polygon and sector."""
    return stores_in_polygons(polygons, stores.select("id", "sector", "lat", "lng")) \
        .groupBy("poly_id", "sector").agg(F.count(F.lit(1)).alias("n"))


def _segments(routes: DataFrame) -> DataFrame:
    pts = F.col("points")
    n = F.size(pts)
    seg = F.arrays_zip(F.slice(pts, 1, n - 1).alias("a"), F.slice(pts, 2, n - 1).alias("b"))
    return routes.select("route_id", "radius_m", F.posexplode(seg).alias("seg_no", "s")).select(
        "route_id", "radius_m", "seg_no", F.col("s.a.lat").alias("alat"), F.col("s.a.lng").alias("alng"),
        F.col("s.b.lat").alias("blat"), F.col("s.b.lng").alias("blng"))


def segment_distance(lat: Column, lng: Column) -> Column:
    """Planar metres from (lat, lng) to segment (alat, alng)-(blat, blng)."""
    kx = F.lit(M_PER_DEG) * F.cos((F.col("alat") + F.col("blat")) * F.lit(0.5) * F.lit(math.pi) / F.lit(180.0))
    ky = F.lit(M_PER_DEG)
    bx = (F.col("blng") - F.col("alng")) * kx
    by = (F.col("blat") - F.col("alat")) * ky
    px = (lng - F.col("alng")) * kx
    py = (lat - F.col("alat")) * ky
    len2 = bx * bx + by * by
    t = F.when(len2 > 0, F.least(F.greatest((px * bx + py * by) / len2, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    dx = px - t * bx
    dy = py - t * by
    return F.sqrt(dx * dx + dy * dy)


def stores_along_routes(routes: DataFrame, stores: DataFrame, max_broadcast_rows: int = 2_000_000,
                        sector: str | None = None) -> DataFrame:
    """``route_id, id, sector, distance_m`` for stores (of ``sector``, if
    given) within the route's radius of any of its segments (``routes``:
    ``route_id, radius_m, points array<struct<lat double, lng double>>``)."""
    if sector is not None:
        stores = stores.filter(F.col("sector") == sector)
    seg = _segments(routes)
    pad_lat = geo.lat_reach_deg(F.col("radius_m"))
    far = F.greatest(F.abs(F.col("alat")), F.abs(F.col("blat"))) + pad_lat
    pad_lng = F.when(far >= 89.0, F.lit(180.0)).otherwise(pad_lat / F.cos(F.radians(far)))
    seg = seg.select("*",
                     (F.least("alat", "blat") - pad_lat).alias("s_lat0"), (F.greatest("alat", "blat") + pad_lat).alias("s_lat1"),
                     (F.least("alng", "blng") - pad_lng).alias("s_lng0"), (F.greatest("alng", "blng") + pad_lng).alias("s_lng1"))
    cells = _box_cells(seg, F.col("s_lat0"), F.col("s_lat1"), F.col("s_lng0"), F.col("s_lng1"))
    cand = _join_cells(cells, stores.select("id", "sector", "lat", "lng"), max_broadcast_rows, "route_id", F.lit(128))
    d = cand.withColumn("d", segment_distance(F.col("lat"), F.col("lng")))
    near = d.filter(F.col("d") <= F.col("radius_m"))
    return near.groupBy("route_id", "id", "sector").agg(F.min("d").alias("d")) \
               .select("route_id", "id", "sector", (F.floor(F.col("d") * 100.0 + 0.5) / 100.0).alias("distance_m"))
