"""Tier-2 area and trend queries: X2, X4, X7, X8, X9, X12, X14, X15, X21, X22."""

from __future__ import annotations

from sitelens.operators import areas as ar
from sitelens.operators import trends as tr
from sitelens.plans.catalog.common import AS_OF, with_store
from sitelens.plans.registry import register
from sitelens.sources.store_view import store_view

EV = """ev AS (SELECT id, sector, lat, lng, 'open' AS kind, open_date AS event_date FROM store WHERE open_date IS NOT NULL
       UNION ALL
       SELECT id, sector, lat, lng, 'close' AS kind, close_date AS event_date FROM store WHERE close_date IS NOT NULL)"""
MONTH = "CAST(date_trunc('month', event_date) AS DATE)"


def _v(spark, sf_dir):
    return store_view(spark, sf_dir)


@register("event_heatmap", with_store(f"""
SELECT {MONTH} AS month, CAST(floor(lat / 1e-2) AS BIGINT) AS cell_lat, CAST(floor(lng / 1e-2) AS BIGINT) AS cell_lng,
       kind, count(*) AS n
FROM ev WHERE lat IS NOT NULL GROUP BY 1, 2, 3, 4""", EV))
def q_event_heatmap(spark, sf_dir):
    return tr.event_heatmap(_v(spark, sf_dir))


@register("activity_series", with_store("""
SELECT cal.month, CAST(coalesce(openings, 0) AS BIGINT) AS openings, CAST(coalesce(closings, 0) AS BIGINT) AS closings,
       CAST(sum(coalesce(openings, 0) - coalesce(closings, 0))
            OVER (ORDER BY cal.month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS active
FROM cal LEFT JOIN m ON cal.month = m.month""", EV, f"""
m AS (SELECT {MONTH} AS month, count(*) FILTER (WHERE kind = 'open') AS openings,
             count(*) FILTER (WHERE kind = 'close') AS closings FROM ev GROUP BY 1)""", """
cal AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH))
             AS DATE) AS month)"""))
def q_activity_series(spark, sf_dir):
    return tr.activity_series(_v(spark, sf_dir))


@register("sector_growth", with_store("""
SELECT sector, month, openings, prev_openings,
       CASE WHEN prev_openings > 0 THEN (openings - prev_openings) / prev_openings END AS growth
FROM (SELECT c.sector, c.month, CAST(coalesce(m.openings, 0) AS BIGINT) AS openings,
             CAST(lag(coalesce(m.openings, 0)) OVER (PARTITION BY c.sector ORDER BY c.month) AS BIGINT) AS prev_openings
      FROM cal c LEFT JOIN m ON c.sector = m.sector AND c.month = m.month) t""", EV, f"""
m AS (SELECT sector, {MONTH} AS month, count(*) FILTER (WHERE kind = 'open') AS openings
      FROM ev WHERE sector IS NOT NULL GROUP BY 1, 2)""", """
cal AS (SELECT sector, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
        FROM m GROUP BY sector)"""))
def q_sector_growth(spark, sf_dir):
    return tr.sector_growth(_v(spark, sf_dir))


@register("sector_growth_yearly", with_store("""
SELECT sector, year, active, prev_active, CASE WHEN prev_active > 0 THEN (active - prev_active) / prev_active END AS growth
FROM (SELECT *, lag(active) OVER (PARTITION BY sector ORDER BY year) AS prev_active
      FROM (SELECT c.sector, CAST(c.year AS BIGINT) AS year,
                   CAST(sum(coalesce(y.net, 0)) OVER (PARTITION BY c.sector ORDER BY c.year) AS BIGINT) AS active
            FROM cal_y c LEFT JOIN y ON c.sector = y.sector AND c.year = y.year) a) t""", EV, """
y AS (SELECT sector, CAST(year(event_date) AS BIGINT) AS year, sum(CASE WHEN kind = 'open' THEN 1 ELSE -1 END) AS net
      FROM ev WHERE sector IS NOT NULL GROUP BY 1, 2)""", """
cal_y AS (SELECT sector, unnest(generate_series(min(year), max(year))) AS year FROM y GROUP BY sector)"""))
def q_sector_growth_yearly(spark, sf_dir):
    return tr.sector_growth_yearly(_v(spark, sf_dir))


@register("grid_density", with_store("""
SELECT cell_lat, cell_lng, sector, n,
       floor(1.1132e0 * 1.1132e0 * cos((cell_lat + 5e-1) * 1e-2 * pi() / 1.8e2) * 1e6 + 5e-1) / 1e6 AS area_km2,
       floor(n / (1.1132e0 * 1.1132e0 * cos((cell_lat + 5e-1) * 1e-2 * pi() / 1.8e2)) * 1e6 + 5e-1) / 1e6 AS density
FROM (SELECT CAST(floor(lat / 1e-2) AS BIGINT) AS cell_lat, CAST(floor(lng / 1e-2) AS BIGINT) AS cell_lng, sector,
             count(*) AS n FROM store WHERE lat IS NOT NULL GROUP BY 1, 2, 3) t"""))
def q_grid_density(spark, sf_dir):
    return ar.grid_density(_v(spark, sf_dir))


@register("sector_share", with_store("""
SELECT address, sector, n, floor(n / sum(n) OVER (PARTITION BY address) * 1e2 * 1e2 + 5e-1) / 1e2 AS share_pct
FROM (SELECT address, sector, count(*) AS n FROM store GROUP BY 1, 2) t"""))
def q_sector_share(spark, sf_dir):
    return ar.sector_share(_v(spark, sf_dir))


@register("area_stats", with_store("""
SELECT address, count(*) AS n_stores, count(*) FILTER (WHERE close_date IS NULL) AS n_open,
       count(DISTINCT sector) AS n_sectors,
       DATE '1970-01-01' + CAST(floor(avg(open_date - DATE '1970-01-01')) AS INTEGER) AS mean_open_date
FROM store GROUP BY address"""))
def q_area_stats(spark, sf_dir):
    return ar.area_stats(_v(spark, sf_dir))


@register("district_rollup", with_store("""
SELECT si, gu, dong, count(*) AS n, CAST(GROUPING(si, gu, dong) AS BIGINT) AS level
FROM (SELECT toks[1] AS si, CASE WHEN len(toks) >= 2 THEN toks[2] END AS gu,
             CASE WHEN len(toks) >= 3 THEN toks[3] END AS dong
      FROM (SELECT regexp_split_to_array(trim(address), '\\s+') AS toks FROM store) a) t
GROUP BY ROLLUP (si, gu, dong)"""))
def q_district_rollup(spark, sf_dir):
    return ar.district_rollup(_v(spark, sf_dir))


@register("sector_dispersion", with_store("""
SELECT sector, CAST(n_stores AS BIGINT) AS n_stores, occupied_cells, CAST(box_cells AS BIGINT) AS box_cells,
       floor(n_stores / box_cells * 1e4 + 5e-1) / 1e4 AS mean_per_cell,
       floor(CASE WHEN n_stores / box_cells > 0 THEN (sum_sq / box_cells - (n_stores / box_cells) * (n_stores / box_cells))
                  / (n_stores / box_cells) END * 1e4 + 5e-1) / 1e4 AS vmr
FROM (SELECT sector, sum(n) AS n_stores, sum(n * n) AS sum_sq, count(*) AS occupied_cells,
             (max(cy) - min(cy) + 1) * (max(cx) - min(cx) + 1) AS box_cells
      FROM (SELECT sector, CAST(floor(lat / 1e-2) AS BIGINT) AS cy, CAST(floor(lng / 1e-2) AS BIGINT) AS cx, count(*) AS n
            FROM store WHERE lat IS NOT NULL AND sector IS NOT NULL GROUP BY 1, 2, 3) c
      GROUP BY sector) s"""))
def q_sector_dispersion(spark, sf_dir):
    return ar.dispersion(_v(spark, sf_dir))


@register("search_page", with_store("""
SELECT * FROM (
  SELECT id, store_name, sector, address, open_date, close_date, lat, lng,
         CAST(row_number() OVER (ORDER BY open_date DESC NULLS FIRST, id) AS BIGINT) AS rn
  FROM store WHERE store_name ILIKE '%Customer#0000001%' OR address ILIKE '%Customer#0000001%') t
WHERE rn > 20 AND rn <= 40"""))
def q_search_page(spark, sf_dir):
    return ar.search_page(_v(spark, sf_dir), "Customer#0000001", page=2, page_size=20)


@register("viewport", with_store("""
SELECT id, store_name, sector, address, open_date, close_date, lat, lng FROM store
WHERE lat BETWEEN 3.752e1 AND 3.756e1 AND lng BETWEEN 1.2695e2 AND 1.2700e2"""))
def q_viewport(spark, sf_dir):
    return ar.in_viewport(_v(spark, sf_dir), 37.52, 126.95, 37.56, 127.0)


@register("store_markers", with_store(f"""
SELECT s.id, s.sector,
       floor((s.lng - c.lng0) * 1.1132e5 * cos(c.lat0 * pi() / 1.8e2) * 1e2 + 5e-1) / 1e2 AS x_m,
       floor((s.lat - c.lat0) * 1.1132e5 * 1e2 + 5e-1) / 1e2 AS y_m,
       floor(CASE WHEN s.open_date IS NULL THEN 5e-1
                  ELSE least(date_diff('day', s.open_date, DATE '{AS_OF}') / 3.65e2, 3e0) END * 1e4 + 5e-1) / 1e4 AS height,
       1e-2 AS grid_deg, CAST(floor(s.lat / 1e-2) AS BIGINT) AS cell_lat, CAST(floor(s.lng / 1e-2) AS BIGINT) AS cell_lng
FROM store s,
     (SELECT (min(lat) + max(lat)) * 5e-1 AS lat0, (min(lng) + max(lng)) * 5e-1 AS lng0
      FROM store WHERE lat IS NOT NULL AND lng IS NOT NULL) c
WHERE s.lat IS NOT NULL AND s.lng IS NOT NULL"""))
def q_store_markers(spark, sf_dir):
    return ar.store_markers(_v(spark, sf_dir), AS_OF, zoom=14)
