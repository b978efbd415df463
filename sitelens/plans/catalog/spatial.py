"""Spatial family: J1-J4 over one candidate site per customer.

Oracles are brute-force cross joins of sites x stores in DuckDB with the
same distance expression text; the Spark side uses the grid join.
"""

from __future__ import annotations

from sitelens.functions import geo
from sitelens.operators import nearby
from sitelens.plans.catalog.common import with_store, with_store_sites
from sitelens.plans.registry import register
from sitelens.sources.sites import customer_sites, landmark_sites, landmark_sql
from sitelens.sources.store_view import store_view

SPH = geo.spheroid_sql("s.lat", "s.lng", "st.lat", "st.lng")
HAV = geo.haversine_sql("s.lat", "s.lng", "st.lat", "st.lng")


GEOJSON = geo.geojson_sql("st.lat", "st.lng")

PAIRS_SPH = f"""
pairs AS (
  SELECT s.site_id, s.radius_m, s.sector AS site_sector, st.id AS sid, st.store_name, st.sector, st.address,
         st.open_date, st.close_date, {GEOJSON} AS location, {SPH} AS distance_m
  FROM sites s JOIN store st ON st.lat IS NOT NULL AND st.lng IS NOT NULL
  WHERE (s.sector IS NULL OR s.sector = st.sector) AND {SPH} <= s.radius_m)
"""


def _sites(spark, sf_dir):
    return customer_sites(spark, sf_dir)


COMPETITION_BODY = """
SELECT s.site_id, s.sector, CAST(count(p.sid) AS BIGINT) AS total_count
FROM sites s LEFT JOIN pairs p ON p.site_id = s.site_id
GROUP BY s.site_id, s.sector"""


@register("competition_count", with_store_sites(COMPETITION_BODY, PAIRS_SPH))
def q_competition_count(spark, sf_dir):
    return nearby.competition_count(_sites(spark, sf_dir), store_view(spark, sf_dir))


@register("competition_count_landmarks", with_store(COMPETITION_BODY, landmark_sql(1000.0), PAIRS_SPH))
def q_competition_count_landmarks(spark, sf_dir):
    return nearby.competition_count(landmark_sites(spark, 1000.0), store_view(spark, sf_dir))


@register("radius_list", with_store_sites("""
SELECT site_id, rn, id, store_name, sector, address, location FROM (
  SELECT site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY open_date DESC NULLS FIRST, sid) AS BIGINT) AS rn,
         CAST(sid AS VARCHAR) AS id, coalesce(store_name, '') AS store_name, sector, address, location
  FROM pairs) t
WHERE rn <= 100""", PAIRS_SPH))
def q_radius_list(spark, sf_dir):
    return nearby.radius_list(_sites(spark, sf_dir), store_view(spark, sf_dir))


_SORT_SQL = {
    "distance_asc": "distance_m ASC",
    "distance_desc": "distance_m DESC",
    "open_date_desc": "open_date DESC NULLS FIRST",
    "open_date_asc": "open_date ASC NULLS LAST",
    "sector_asc": "sector ASC NULLS LAST, open_date DESC NULLS FIRST",
}

# Fixed parameters of the registered page queries: (sort, page, page size).
PAGE_CASES = [("distance_asc", 1, 20), ("distance_desc", 2, 20), ("open_date_desc", 1, 20),
              ("open_date_asc", 3, 10), ("sector_asc", 1, 20)]


def _page_sql(sort: str, page: int, size: int) -> str:
    lo, hi = (page - 1) * size, page * size
    return with_store_sites(f"""
SELECT r.site_id, r.rn, r.id, r.store_name, r.sector, r.address, r.location, r.open_date,
       floor(r.distance_m * 1e2 + 5e-1) / 1e2 AS distance_m, t.total_count,
       CAST({page} AS BIGINT) AS page, CAST({size} AS BIGINT) AS page_size,
       CAST(ceil(t.total_count / {float(size)!r}e0) AS BIGINT) AS total_pages,
       {page} < CAST(ceil(t.total_count / {float(size)!r}e0) AS BIGINT) AS has_next,
       {'true' if page > 1 else 'false'} AS has_prev
FROM (
  SELECT site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY {_SORT_SQL[sort]}, sid) AS BIGINT) AS rn,
         CAST(sid AS VARCHAR) AS id, coalesce(store_name, '') AS store_name, sector, address, location,
         open_date, distance_m
  FROM pairs) r
JOIN (SELECT site_id, count(*) AS total_count FROM pairs GROUP BY site_id) t ON r.site_id = t.site_id
WHERE r.rn > {lo} AND r.rn <= {hi}""", PAIRS_SPH)


def _page_query(sort: str, page: int, size: int):
    def q(spark, sf_dir):
        return nearby.radius_page(_sites(spark, sf_dir), store_view(spark, sf_dir), sort, page, size)
    return q


for _sort, _page, _size in PAGE_CASES:
    register(f"radius_page_{_sort}", _page_sql(_sort, _page, _size))(_page_query(_sort, _page, _size))


@register("radius_page_meta", with_store_sites("""
SELECT s.site_id, CAST(count(p.sid) AS BIGINT) AS total_count, CAST(1 AS BIGINT) AS page,
       CAST(20 AS BIGINT) AS page_size, CAST(ceil(count(p.sid) / 2e1) AS BIGINT) AS total_pages,
       1 < CAST(ceil(count(p.sid) / 2e1) AS BIGINT) AS has_next, false AS has_prev
FROM sites s LEFT JOIN pairs p ON p.site_id = s.site_id
GROUP BY s.site_id""", PAIRS_SPH))
def q_radius_page_meta(spark, sf_dir):
    return nearby.radius_page_meta(_sites(spark, sf_dir), store_view(spark, sf_dir))
