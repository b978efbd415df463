"""Polygon (X1) and route (X6) queries over the whole store table."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sitelens.operators import shapes as sh
from sitelens.plans.catalog.common import with_store
from sitelens.plans.registry import register
from sitelens.sources.store_view import store_view

# Fixed parameters: two areas (a triangle and a concave L) and two routes
# through the manual-test places, as (lat, lng) vertices.
POLYGONS = [
    (1, [(37.50, 126.95), (37.58, 126.97), (37.52, 127.05)]),
    (2, [(37.49, 126.91), (37.55, 126.91), (37.55, 126.94), (37.52, 126.94), (37.52, 127.00), (37.49, 127.00)]),
]
ROUTES = [
    (1, 300.0, [(37.5563, 126.9236), (37.5551, 126.9368), (37.5636, 126.9826), (37.5704, 126.9918),
                (37.5345, 126.9949), (37.4980, 127.0276)]),
    (2, 150.0, [(37.5133, 127.1028), (37.5407, 127.0692), (37.4980, 127.0276)]),
]
PT = "array<struct<lat double, lng double>>"


def _d(v: float) -> str:
    return f"{v:.17e}"


def _pts_sql(pts) -> str:
    return "[" + ", ".join(f"{{'lat': {_d(a)}, 'lng': {_d(b)}}}" for a, b in pts) + "]"


def polygons_df(spark: SparkSession):
    return spark.createDataFrame([(i, [{"lat": a, "lng": b} for a, b in v]) for i, v in POLYGONS],
                                 f"poly_id long, vertices {PT}")


def routes_df(spark: SparkSession):
    return spark.createDataFrame([(i, r, [{"lat": a, "lng": b} for a, b in v]) for i, r, v in ROUTES],
                                 f"route_id long, radius_m double, points {PT}")


POLY_SQL = with_store("""
SELECT poly_id, sector, count(*) AS n FROM (
  SELECT e.poly_id, st.id, st.sector
  FROM store st JOIN bbox b ON st.lat BETWEEN b.lat0 AND b.lat1 AND st.lng BETWEEN b.lng0 AND b.lng1
  JOIN edges e ON e.poly_id = b.poly_id
  GROUP BY e.poly_id, st.id, st.sector
  HAVING sum(CASE WHEN (e.alat > st.lat) <> (e.blat > st.lat) THEN
               CASE WHEN st.lng < (e.blng - e.alng) * (st.lat - e.alat) / (e.blat - e.alat) + e.alng THEN 1 ELSE 0 END
             ELSE 0 END) % 2 = 1) t
GROUP BY poly_id, sector""",
    "poly(poly_id, v) AS (VALUES " + ", ".join(f"({i}, {_pts_sql(v)})" for i, v in POLYGONS) + ")",
    """edges AS (SELECT poly_id, v[i].lat AS alat, v[i].lng AS alng,
                      v[CASE WHEN i = len(v) THEN 1 ELSE i + 1 END].lat AS blat,
                      v[CASE WHEN i = len(v) THEN 1 ELSE i + 1 END].lng AS blng
               FROM (SELECT poly_id, v, unnest(range(1, len(v) + 1)) AS i FROM poly) x)""",
    """bbox AS (SELECT poly_id, min(alat) AS lat0, max(alat) AS lat1, min(alng) AS lng0, max(alng) AS lng1
              FROM edges GROUP BY poly_id)""")


@register("polygon_sector_counts", POLY_SQL)
def q_polygon_sector_counts(spark, sf_dir):
    return sh.polygon_sector_counts(polygons_df(spark), store_view(spark, sf_dir))


_KX = "1.1132e5 * cos((s.alat + s.blat) * 5e-1 * pi() / 1.8e2)"
_BX = f"((s.blng - s.alng) * {_KX})"
_BY = "((s.blat - s.alat) * 1.1132e5)"
_PX = f"((st.lng - s.alng) * {_KX})"
_PY = "((st.lat - s.alat) * 1.1132e5)"
_LEN2 = f"({_BX} * {_BX} + {_BY} * {_BY})"
_T = f"(CASE WHEN {_LEN2} > 0 THEN least(greatest(({_PX} * {_BX} + {_PY} * {_BY}) / {_LEN2}, 0e0), 1e0) ELSE 0e0 END)"
_DX = f"({_PX} - {_T} * {_BX})"
_DY = f"({_PY} - {_T} * {_BY})"
SEG_D = f"sqrt({_DX} * {_DX} + {_DY} * {_DY})"

ROUTE_SQL = with_store(f"""
SELECT route_id, id, sector, floor(min(d) * 1e2 + 5e-1) / 1e2 AS distance_m FROM (
  SELECT s.route_id, st.id, st.sector, s.radius_m, {SEG_D} AS d
  FROM segs s, store st WHERE st.lat IS NOT NULL AND st.lng IS NOT NULL) x
WHERE d <= radius_m GROUP BY route_id, id, sector""",
    "routes(route_id, radius_m, p) AS (VALUES " + ", ".join(
        f"({i}, {_d(r)}, {_pts_sql(v)})" for i, r, v in ROUTES) + ")",
    """segs AS (SELECT route_id, radius_m, p[i].lat AS alat, p[i].lng AS alng, p[i + 1].lat AS blat, p[i + 1].lng AS blng
              FROM (SELECT route_id, radius_m, p, unnest(range(1, len(p))) AS i FROM routes) x)""")


@register("route_stores", ROUTE_SQL)
def q_route_stores(spark, sf_dir):
    return sh.stores_along_routes(routes_df(spark), store_view(spark, sf_dir))
