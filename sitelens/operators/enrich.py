"""Coordinate enrichment: fill missing store coordinates from an address
table, with the quota / batch bookkeeping of the original geocoding run,
and point text formats (WKT, GeoJSON) both ways.

The original called a web geocoder from 15 threads and wrote one UPDATE per
row; here the geocoder's answers are a table (``address_coords``: address,
rank, lng, lat) and filling is one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import geo

# Per-session success quota and batch size of the original run.
DAILY_QUOTA = 100_000
BATCH_SIZE = 5_000


def pending(stores: DataFrame) -> DataFrame:
    """Stores still without coordinates but with an address."""
    return stores.filter(F.col("lat").isNull() & F.col("address").isNotNull())


def best_coords(address_coords: DataFrame) -> DataFrame:
    """One answer per address: the lowest ``rank`` wins (first document).

    ``min_by`` is an aggregate, so it is combined map-side: an address with
    a huge number of candidate answers never lands whole in one task.
    """
    ok = address_coords.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    best = ok.groupBy("address").agg(
        F.min_by(F.struct("lat", "lng"), F.struct("rank", "lng", "lat")).alias("b"))
    return best.select("address", F.col("b.lat").alias("new_lat"), F.col("b.lng").alias("new_lng"))


def geocode_apply(stores: DataFrame, address_coords: DataFrame) -> DataFrame:
    """Every store; missing coordinates filled where the address has
    an answer (existing coordinates are never overwritten); ``geocoded``
    marks the rows filled here.  One left join on ``address`` -- a hot
    address is split by AQE's skew join on the store side."""
    best = best_coords(address_coords)
    # Rows that cannot be filled (located, or without an address, which would
    # all hash to one task) get a key of their own that no address equals.
    open_rows = F.col("lat").isNull() & F.col("address").isNotNull()
    key = F.when(open_rows, F.concat(F.lit("a:"), F.col("address"))).otherwise(F.concat(F.lit("r:"), F.col("id").cast("string")))
    j = stores.join(best.select(F.concat(F.lit("a:"), F.col("address")).alias("_address"), "new_lat", "new_lng"),
                    key == F.col("_address"), "left")
    fill = F.col("lat").isNull() & F.col("new_lat").isNotNull()
    cols = [c for c in stores.columns if c not in ("lat", "lng")]
    return j.select(*cols,
                    F.when(fill, F.col("new_lat")).otherwise(F.col("lat")).alias("lat"),
                    F.when(fill, F.col("new_lng")).otherwise(F.col("lng")).alias("lng"),
                    fill.alias("geocoded"))


def geocode_batches(stores: DataFrame, address_coords: DataFrame, quota: int = DAILY_QUOTA,
                    batch_size: int = BATCH_SIZE) -> DataFrame:
    """The successes one session may write: the first ``quota`` pending
    stores (by id) whose address has an answer, with their batch number and
    the WKT written back.  The top-k keeps at most ``quota`` rows, so the
    numbering window works on a bounded set."""
    best = best_coords(address_coords)
    hits = pending(stores).select("id", "address").join(best, "address")
    top = hits.orderBy("id").limit(quota)
    numbered = top.withColumn("rn", F.row_number().over(Window.orderBy("id")))
    return numbered.select("id", F.col("rn").cast("long").alias("rn"),
                           F.floor((F.col("rn") - 1) / batch_size).cast("long").alias("batch"),
                           geo.wkt_build(F.col("new_lat"), F.col("new_lng")).alias("wkt"))


def geocode_remaining(stores: DataFrame, address_coords: DataFrame) -> DataFrame:
    """Pending before, filled, and still pending after one pass."""
    applied = geocode_apply(stores, address_coords)
    return applied.agg(
        F.count_if(F.col("geocoded") | (F.col("lat").isNull() & F.col("address").isNotNull())).alias("pending_before"),
        F.count_if(F.col("geocoded")).alias("geocoded"),
        F.count_if(F.col("lat").isNull() & F.col("address").isNotNull()).alias("pending_after"))


def wkt_roundtrip(stores: DataFrame) -> DataFrame:
    """Build ``POINT(lng lat)`` and parse it back."""
    located = stores.filter(F.col("lat").isNotNull())
    wkt = geo.wkt_build(F.col("lat"), F.col("lng"))
    lat, lng = geo.wkt_parse(wkt)
    return located.select("id", wkt.alias("wkt"), lat.alias("lat"), lng.alias("lng"))


def geojson_roundtrip(stores: DataFrame) -> DataFrame:
    """GeoJSON text of each located store and the point read back."""
    located = stores.filter(F.col("lat").isNotNull())
    g = geo.geojson_build(F.col("lat"), F.col("lng"))
    lat, lng = geo.geojson_parse(g)
    return located.select("id", g.alias("location"), lat.alias("lat"), lng.alias("lng"))


def snap_sites(sites: DataFrame) -> DataFrame:
    """The original's cache-key snapping -- lat/lng to 4 decimals,
    radius to 100 m, ``all`` without a sector (``snap_key``) -- next to the
    true radius and sector, which answers are computed with."""
    lat4 = F.floor(F.col("lat") * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)
    lng4 = F.floor(F.col("lng") * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)
    r100 = F.floor(F.col("radius_m") / F.lit(100.0) + F.lit(0.5)) * F.lit(100.0)
    key = F.concat_ws(":", F.lit("spatial:stores"), lat4.cast("string"), lng4.cast("string"),
                      r100.cast("long").cast("string"), F.coalesce(F.col("sector"), F.lit("all")))
    return sites.select("site_id", "radius_m", "sector", lat4.alias("snap_lat"), lng4.alias("snap_lng"), r100.alias("snap_radius_m"),
                        key.alias("snap_key"))


def request_key() -> Column:
    """Exact text of a snapped request: point, true radius, and sector (a
    missing sector has no sector part, so no name can equal it)."""
    return F.concat_ws(":", F.col("snap_lat").cast("string"), F.col("snap_lng").cast("string"),
                       F.col("radius_m").cast("string"), F.concat(F.lit("sector="), F.col("sector")))


def distinct_requests(sites: DataFrame) -> DataFrame:
    """G10 dedupe: one row per snapped request with the number of sites it
    stands for (partial aggregation; the answer is joined back on the key)."""
    return snap_sites(sites).groupBy("snap_lat", "snap_lng", "snap_radius_m", "sector") \
                  .agg(F.count(F.lit(1)).alias("n_sites"))


def address_coords_from_located(stores: DataFrame) -> DataFrame:
    """An address table built from stores that already have coordinates
    (rank = store id): the stand-in for the external geocoder's answers."""
    return stores.filter(F.col("lat").isNotNull() & F.col("address").isNotNull()) \
                 .select("address", F.col("id").alias("rank"), "lng", "lat")
