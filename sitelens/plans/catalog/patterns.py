"""Pattern queries: X5 clusters (oracle: recursive CTE), X10, X11, X13."""

from __future__ import annotations

from sitelens.operators import patterns as pt
from sitelens.plans.catalog.common import with_store, with_store_sites
from sitelens.plans.catalog.spatial import SPH
from sitelens.plans.registry import register
from sitelens.sources.sites import customer_sites
from sitelens.sources.store_view import store_view


@register("dense_clusters", with_store("""
SELECT cluster, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_stores,
       min(cy) * 5e-3 AS min_lat, (max(cy) + 1) * 5e-3 AS max_lat,
       min(cx) * 5e-3 AS min_lng, (max(cx) + 1) * 5e-3 AS max_lng
FROM (SELECT d.cx, d.cy, d.n, min(l.label) AS cluster
      FROM dense d JOIN lab l ON l.cx = d.cx AND l.cy = d.cy GROUP BY d.cx, d.cy, d.n) t
GROUP BY cluster""", """cells AS (SELECT CAST(floor(lng / 5e-3) AS BIGINT) AS cx, CAST(floor(lat / 5e-3) AS BIGINT) AS cy,
                      count(*) AS n FROM store WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY 1, 2)""",
    """dense AS (SELECT cx, cy, n FROM cells WHERE n >= 1.1e0 * (SELECT avg(n) FROM cells))""",
    """RECURSIVE lab(cx, cy, label) AS (
      SELECT cx, cy, cx * 4294967296 + cy FROM dense
      UNION
      SELECT d.cx, d.cy, l.label FROM lab l JOIN dense d ON abs(d.cx - l.cx) <= 1 AND abs(d.cy - l.cy) <= 1)"""))
def q_dense_clusters(spark, sf_dir):
    return pt.dense_clusters(store_view(spark, sf_dir), grid_deg=0.005, factor=1.1)


@register("competition_index", with_store_sites("""
SELECT c.site_id, c.sector, c.total_count,
       floor(CASE WHEN coalesce(ps.n_sector, t.n_total) / b.box_km2 > 0 THEN
             (c.total_count / (pi() * s.radius_m * s.radius_m / 1e6)) / (coalesce(ps.n_sector, t.n_total) / b.box_km2)
             END * 1e4 + 5e-1) / 1e4 AS competition_index
FROM cnt c JOIN sites s ON c.site_id = s.site_id
LEFT JOIN (SELECT sector, count(*) AS n_sector FROM loc GROUP BY sector) ps ON c.sector = ps.sector,
     (SELECT count(*) AS n_total FROM loc) t,
     (SELECT (max(lat) - min(lat)) * 1.1132e2 * (max(lng) - min(lng)) * 1.1132e2
             * cos((min(lat) + max(lat)) * 5e-1 * pi() / 1.8e2) AS box_km2 FROM loc) b""",
    "loc AS (SELECT * FROM store WHERE lat IS NOT NULL AND lng IS NOT NULL)",
    f"""cnt AS (SELECT s.site_id, s.sector, CAST(count(st.id) AS BIGINT) AS total_count
            FROM sites s LEFT JOIN store st ON st.lat IS NOT NULL AND st.lng IS NOT NULL
              AND (s.sector IS NULL OR s.sector = st.sector) AND {SPH} <= s.radius_m
            GROUP BY s.site_id, s.sector)"""))
def q_competition_index(spark, sf_dir):
    return pt.competition_index(customer_sites(spark, sf_dir), store_view(spark, sf_dir))


@register("market_potential", with_store_sites("""
SELECT s.site_id, s.sector, CAST(coalesce(l.n_closed, 0) AS BIGINT) AS n_closed,
       floor(l.local_avg * 1e2 + 5e-1) / 1e2 AS local_avg_days, r.sector_avg,
       floor(CASE WHEN r.sector_avg > 0 THEN l.local_avg / r.sector_avg END * 1e4 + 5e-1) / 1e4 AS potential
FROM sites s
LEFT JOIN (SELECT s.site_id, avg(date_diff('day', st.open_date, st.close_date)) AS local_avg, count(*) AS n_closed
           FROM sites s JOIN store st ON st.lat IS NOT NULL AND st.lng IS NOT NULL AND st.close_date IS NOT NULL
             AND st.open_date IS NOT NULL AND date_diff('day', st.open_date, st.close_date) >= 0
             AND (s.sector IS NULL OR s.sector = st.sector) AND """ + SPH.replace("st.", "st.") + """ <= s.radius_m
           GROUP BY s.site_id) l ON s.site_id = l.site_id
LEFT JOIN (SELECT sector, floor(avg(date_diff('day', open_date, close_date)) * 1e2 + 5e-1) / 1e2 AS sector_avg
           FROM store WHERE close_date IS NOT NULL AND open_date IS NOT NULL
             AND date_diff('day', open_date, close_date) >= 0 GROUP BY sector) r ON s.sector = r.sector"""))
def q_market_potential(spark, sf_dir):
    return pt.market_potential(customer_sites(spark, sf_dir), store_view(spark, sf_dir))


@register("sector_colocation", with_store_sites("""
SELECT a.sector AS sector_a, b.sector AS sector_b, floor(corr(a.n, b.n) * 1e6 + 5e-1) / 1e6 AS corr,
       count(*) FILTER (WHERE a.n > 0 AND b.n > 0) AS cells_both
FROM filled a JOIN filled b ON a.cx = b.cx AND a.cy = b.cy AND a.sector < b.sector
GROUP BY a.sector, b.sector""", """cnt AS (SELECT CAST(floor(lat / 1e-2) AS BIGINT) AS cy, CAST(floor(lng / 1e-2) AS BIGINT) AS cx, sector,
                   CAST(count(*) AS DOUBLE) AS n
            FROM store WHERE lat IS NOT NULL AND lng IS NOT NULL AND sector IS NOT NULL GROUP BY 1, 2, 3)""",
    """filled AS (SELECT c.cy, c.cx, s.sector, coalesce(t.n, 0e0) AS n
               FROM (SELECT DISTINCT cy, cx FROM cnt) c CROSS JOIN (SELECT DISTINCT sector FROM cnt) s
               LEFT JOIN cnt t ON t.cy = c.cy AND t.cx = c.cx AND t.sector = s.sector)"""))
def q_sector_colocation(spark, sf_dir):
    return pt.sector_colocation(store_view(spark, sf_dir))
