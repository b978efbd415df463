"""Moran statistics (X12); the oracle writes out every (sector, cell) pair, zeros included."""

from __future__ import annotations

from sitelens.operators import autocorrelation as ac
from sitelens.plans.catalog.common import with_store
from sitelens.plans.registry import register
from sitelens.sources.store_view import store_view

CELLS = """cells AS (SELECT CAST(floor(lng / 1e-2) AS BIGINT) AS cx, CAST(floor(lat / 1e-2) AS BIGINT) AS cy, count(*) AS n
            FROM store WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY 1, 2)"""
TOUCH = """touch AS (SELECT a.cx, a.cy, b.cx AS bx, b.cy AS byy FROM cells a JOIN cells b
            ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND NOT (a.cx = b.cx AND a.cy = b.cy))"""


@register("sector_moran", with_store("""
SELECT f.sector, f.s AS n_stores, t.n_cells,
       floor(CASE WHEN f.q - f.s * (f.s / t.n_cells) > 0 AND t.links > 0 THEN
             t.n_cells / t.links * (w.c - 2e0 * (f.s / t.n_cells) * w.d + (f.s / t.n_cells) * (f.s / t.n_cells) * t.links)
             / (f.q - f.s * (f.s / t.n_cells)) END * 1e6 + 5e-1) / 1e6 AS moran
FROM (SELECT sector, CAST(sum(n) AS BIGINT) AS s, CAST(sum(n * n) AS BIGINT) AS q FROM filled GROUP BY sector) f
JOIN (SELECT a.sector, CAST(sum(a.n) AS BIGINT) AS d, CAST(sum(a.n * b.n) AS BIGINT) AS c
      FROM filled a JOIN touch x ON x.cx = a.cx AND x.cy = a.cy
      JOIN filled b ON b.cx = x.bx AND b.cy = x.byy AND b.sector = a.sector GROUP BY a.sector) w ON w.sector = f.sector,
     (SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT count(*) FROM touch) AS links) t""", CELLS, TOUCH,
    """filled AS (SELECT c.cx, c.cy, s.sector, CAST(coalesce(p.n, 0) AS BIGINT) AS n FROM cells c
            CROSS JOIN (SELECT DISTINCT sector FROM store WHERE sector IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL) s
            LEFT JOIN (SELECT CAST(floor(lng / 1e-2) AS BIGINT) AS cx, CAST(floor(lat / 1e-2) AS BIGINT) AS cy, sector, count(*) AS n
                       FROM store WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY 1, 2, 3) p
              ON p.cx = c.cx AND p.cy = c.cy AND p.sector = s.sector)"""))
def q_sector_moran(spark, sf_dir):
    return ac.sector_moran(store_view(spark, sf_dir))


@register("local_moran", with_store("""
SELECT cx, cy, n, n_neighbours,
       floor(CASE WHEN n_neighbours > 0 AND m2 > 0 THEN (n - mean) * (lag - n_neighbours * mean) / m2 END * 1e6 + 5e-1) / 1e6 AS local_moran,
       CASE WHEN n_neighbours > 0 AND m2 > 0 THEN
         CASE WHEN n - mean > 0 THEN 'H' ELSE 'L' END || CASE WHEN lag - n_neighbours * mean > 0 THEN 'H' ELSE 'L' END END AS kind
FROM (SELECT c.cx, c.cy, c.n, count(b.n) AS n_neighbours, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS lag
      FROM cells c LEFT JOIN touch x ON x.cx = c.cx AND x.cy = c.cy LEFT JOIN cells b ON b.cx = x.bx AND b.cy = x.byy
      GROUP BY c.cx, c.cy, c.n) r,
     (SELECT s / n_cells AS mean, (q - s * (s / n_cells)) / n_cells AS m2
      FROM (SELECT count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS s, CAST(sum(n * n) AS BIGINT) AS q FROM cells) u) t""",
    CELLS, TOUCH))
def q_local_moran(spark, sf_dir):
    return ac.local_moran(store_view(spark, sf_dir))
