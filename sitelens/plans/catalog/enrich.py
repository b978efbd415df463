"""Enrichment family: E1-E5 (E4/E5 live with the store lists), K3, G5-G8, G10."""

from __future__ import annotations

from sitelens.functions import geo
from sitelens.operators import enrich as en
from sitelens.plans.catalog.common import with_store, with_store_sites
from sitelens.plans.registry import register
from sitelens.sources.sites import customer_sites
from sitelens.sources.store_view import store_view

COORDS = """coords AS (SELECT address, id AS rank, lng, lat FROM store WHERE lat IS NOT NULL AND address IS NOT NULL)"""
BEST = """best AS (SELECT address, arg_min(lat, (rank, lng, lat)) AS new_lat, arg_min(lng, (rank, lng, lat)) AS new_lng
                 FROM coords WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY address)"""


def _sc(spark, sf_dir):
    s = store_view(spark, sf_dir)
    return s, en.address_coords_from_located(s)


@register("geocode_apply", with_store("""
SELECT st.id, st.store_name, st.sector, st.address, st.open_date, st.close_date,
       CASE WHEN st.lat IS NULL AND b.new_lat IS NOT NULL THEN b.new_lat ELSE st.lat END AS lat,
       CASE WHEN st.lat IS NULL AND b.new_lat IS NOT NULL THEN b.new_lng ELSE st.lng END AS lng,
       (st.lat IS NULL AND b.new_lat IS NOT NULL) AS geocoded
FROM store st LEFT JOIN best b ON st.address = b.address""", COORDS, BEST))
def q_geocode_apply(spark, sf_dir):
    return en.geocode_apply(*_sc(spark, sf_dir))


@register("geocode_pending", with_store(
    "SELECT id, address FROM store WHERE lat IS NULL AND address IS NOT NULL"))
def q_geocode_pending(spark, sf_dir):
    return en.pending(store_view(spark, sf_dir)).select("id", "address")


@register("geocode_batches", with_store("""
SELECT id, CAST(rn AS BIGINT) AS rn, CAST(floor((rn - 1) / 5000) AS BIGINT) AS batch,
       'POINT(' || CAST(new_lng AS VARCHAR) || ' ' || CAST(new_lat AS VARCHAR) || ')' AS wkt
FROM (SELECT p.id, b.new_lat, b.new_lng, row_number() OVER (ORDER BY p.id) AS rn
      FROM store p JOIN best b ON p.address = b.address
      WHERE p.lat IS NULL AND p.address IS NOT NULL) t
WHERE rn <= 100000""", COORDS, BEST))
def q_geocode_batches(spark, sf_dir):
    return en.geocode_batches(*_sc(spark, sf_dir))


@register("geocode_remaining", with_store("""
SELECT count(*) FILTER (WHERE st.lat IS NULL AND st.address IS NOT NULL) AS pending_before,
       count(*) FILTER (WHERE st.lat IS NULL AND b.new_lat IS NOT NULL) AS geocoded,
       count(*) FILTER (WHERE st.lat IS NULL AND st.address IS NOT NULL AND b.new_lat IS NULL) AS pending_after
FROM store st LEFT JOIN best b ON st.address = b.address""", COORDS, BEST))
def q_geocode_remaining(spark, sf_dir):
    return en.geocode_remaining(*_sc(spark, sf_dir))


@register("wkt_roundtrip", with_store("""
SELECT id, 'POINT(' || CAST(lng AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS wkt, lat, lng
FROM store WHERE lat IS NOT NULL"""))
def q_wkt_roundtrip(spark, sf_dir):
    return en.wkt_roundtrip(store_view(spark, sf_dir))


@register("geojson_roundtrip", with_store("""
SELECT id, """ + geo.geojson_sql("lat", "lng") + """ AS location, lat, lng
FROM store WHERE lat IS NOT NULL"""))
def q_geojson_roundtrip(spark, sf_dir):
    return en.geojson_roundtrip(store_view(spark, sf_dir))


@register("site_snap", with_store_sites("""
SELECT floor(lat * 1e4 + 5e-1) / 1e4 AS snap_lat, floor(lng * 1e4 + 5e-1) / 1e4 AS snap_lng,
       floor(radius_m / 1e2 + 5e-1) * 1e2 AS snap_radius_m, sector, count(*) AS n_sites
FROM sites GROUP BY 1, 2, 3, 4"""))
def q_site_snap(spark, sf_dir):
    return en.distinct_requests(customer_sites(spark, sf_dir))
