"""Areas of any shape: polygons with holes, circles, nested districts."""

from __future__ import annotations

from sitelens.functions import geo
from sitelens.operators import polygons as pg
from sitelens.plans.catalog.common import with_store
from sitelens.plans.registry import register
from sitelens.sources import derived_areas as da
from sitelens.sources.store_view import store_view

IN_NATIONS = f"in_nations AS ({da.in_polygon_sql('nation_edges', 'area_id')})"
CIRCLE_D = geo.distance_sql("spheroid", "c.lat", "c.lng", "st.lat", "st.lng")
IN_AREAS = f"""in_areas AS (
  SELECT * FROM in_nations UNION ALL
  SELECT c.area_id, st.id, st.sector, st.open_date, st.close_date FROM region_circles c
  JOIN store st ON st.lat IS NOT NULL AND {CIRCLE_D} <= c.radius_m)"""
AREAS = (da.NATION_EDGES_SQL, IN_NATIONS, da.REGION_CIRCLES_SQL, IN_AREAS)


@register("area_sector_counts", with_store("SELECT area_id, sector, count(*) AS n FROM in_nations GROUP BY area_id, sector",
                                           da.NATION_EDGES_SQL, IN_NATIONS))
def q_area_sector_counts(spark, sf_dir):
    return pg.area_sector_counts(da.nation_areas(spark, sf_dir), store_view(spark, sf_dir))


@register("area_sector_share", with_store("""
SELECT area_id, sector, n, floor(n / sum(n) OVER (PARTITION BY area_id) * 1e2 * 1e2 + 5e-1) / 1e2 AS share_pct
FROM (SELECT area_id, sector, count(*) AS n FROM in_areas GROUP BY area_id, sector) t""", *AREAS))
def q_area_sector_share(spark, sf_dir):
    return pg.area_sector_share(da.mixed_areas(spark, sf_dir), store_view(spark, sf_dir))


@register("area_statistics", with_store("""
SELECT a.area_id, coalesce(n_stores, 0) AS n_stores, coalesce(n_open, 0) AS n_open, coalesce(n_sectors, 0) AS n_sectors,
       top_sector, mean_open_date
FROM (SELECT DISTINCT area_id FROM nation_edges UNION ALL SELECT area_id FROM region_circles) a
LEFT JOIN (SELECT area_id, count(*) AS n_stores, count(*) FILTER (WHERE close_date IS NULL) AS n_open, count(DISTINCT sector) AS n_sectors,
                  DATE '1970-01-01' + CAST(floor(avg(open_date - DATE '1970-01-01')) AS INTEGER) AS mean_open_date
           FROM in_areas GROUP BY area_id) s USING (area_id)
LEFT JOIN (SELECT area_id, sector AS top_sector FROM (
             SELECT area_id, sector, row_number() OVER (PARTITION BY area_id ORDER BY count(*) DESC, sector) AS rn
             FROM in_areas WHERE sector IS NOT NULL GROUP BY area_id, sector) t WHERE rn = 1) t USING (area_id)""", *AREAS))
def q_area_statistics(spark, sf_dir):
    return pg.area_statistics(da.mixed_areas(spark, sf_dir), store_view(spark, sf_dir))


@register("district_levels", with_store("""
SELECT si, gu, dong, count(*) AS n, count(*) FILTER (WHERE close_date IS NULL) AS n_open,
       CAST(GROUPING(si, gu, dong) AS BIGINT) AS level
FROM (SELECT id, any_value(close_date) AS close_date, min(area_id) FILTER (WHERE level = 'si') AS si,
             min(area_id) FILTER (WHERE level = 'gu') AS gu, min(area_id) FILTER (WHERE level = 'dong') AS dong
      FROM in_districts GROUP BY id) p
GROUP BY ROLLUP (si, gu, dong)""", da.DISTRICTS_SQL, f"in_districts AS ({da.in_polygon_sql('district_edges', 'level, area_id')})"))
def q_district_levels(spark, sf_dir):
    return pg.district_levels(da.districts(spark, sf_dir), store_view(spark, sf_dir), da.DISTRICT_LEVELS)
