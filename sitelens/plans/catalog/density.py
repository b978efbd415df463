"""Density clusters of all sectors (X5); the oracle compares all stores of a sector and walks the links."""

from __future__ import annotations

from sitelens.functions.geo import EARTH_R
from sitelens.operators import density as dn
from sitelens.plans.catalog.common import with_store
from sitelens.plans.registry import register
from sitelens.sources.store_view import store_view

EPS_M, MIN_POINTS = 300.0, 6
REACH = f"{dn.chord(EPS_M):.17e}"
R = f"{EARTH_R:.17e}"

ROLES = (
    f"""pts AS (SELECT id, sector, coalesce(sector, '') AS grp, {R} * cos(lat * pi() / 1.8e2) * cos(lng * pi() / 1.8e2) AS x,
               {R} * cos(lat * pi() / 1.8e2) * sin(lng * pi() / 1.8e2) AS y, {R} * sin(lat * pi() / 1.8e2) AS z
            FROM store WHERE lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180)""",
    f"""near AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.grp = b.grp
             AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {REACH} * {REACH})""",
    f"core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {MIN_POINTS})",
    "link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core))",
    """RECURSIVE walk(id, label) AS (SELECT id, id FROM core UNION
       SELECT l.b, w.label FROM walk w JOIN link l ON l.a = w.id WHERE w.label < l.b)""",
    "named AS (SELECT id, min(label) AS cluster FROM walk GROUP BY id)",
    """judged AS (SELECT p.id, p.sector, CASE WHEN c.id IS NOT NULL THEN 'core' WHEN m.cluster IS NOT NULL THEN 'border' ELSE 'noise' END AS role,
                      coalesce(c.cluster, m.cluster) AS cluster
               FROM pts p LEFT JOIN named c ON c.id = p.id
               LEFT JOIN (SELECT e.a, min(t.cluster) AS cluster FROM near e JOIN named t ON t.id = e.b GROUP BY e.a) m ON m.a = p.id)""")


@register("store_density_roles", with_store("SELECT id, sector, role, cluster FROM judged", *ROLES))
def q_store_density_roles(spark, sf_dir):
    return dn.density_clusters(store_view(spark, sf_dir), EPS_M, MIN_POINTS)


@register("sector_density_clusters", with_store("""
SELECT sector, cluster, count(*) FILTER (WHERE role = 'core') AS n_core, count(*) FILTER (WHERE role = 'border') AS n_border,
       count(*) AS n_stores
FROM judged WHERE cluster IS NOT NULL GROUP BY sector, cluster""", *ROLES))
def q_sector_density_clusters(spark, sf_dir):
    return dn.cluster_summary(store_view(spark, sf_dir), EPS_M, MIN_POINTS)
