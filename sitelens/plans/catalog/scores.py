"""Score family: C1/C2 survival score, C3/C5 site rating."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import scores as sc
from sitelens.plans.catalog.common import AS_OF, with_store, with_store_sites
from sitelens.plans.catalog.spatial import HAV, SPH
from sitelens.plans.registry import register
from sitelens.sources.sites import SITES_SQL, customer_sites
from sitelens.sources.store_view import store_view

_SAME = "(s.sector IS NULL OR s.sector = p.sector)"
_OPEN_NEAR = f"(p.close_date IS NULL AND p.d_hav <= s.radius_m AND {_SAME})"
_DATED = f"({_OPEN_NEAR} AND p.open_date IS NOT NULL)"

AGG_CTES = [
    f"""pairs2 AS (
  SELECT s.site_id, st.sector, st.open_date, st.close_date, {SPH} AS d_sph, {HAV} AS d_hav
  FROM sites s JOIN store st ON st.lat IS NOT NULL AND st.lng IS NOT NULL
  WHERE {SPH} <= s.radius_m OR {HAV} <= s.radius_m)""",
    f"""agg AS (
  SELECT s.site_id, s.sector AS site_sector, s.radius_m,
         count(p.site_id) FILTER (WHERE p.d_sph <= s.radius_m AND {_SAME}) AS n_same,
         count(p.site_id) FILTER (WHERE p.d_sph <= s.radius_m) AS n_all,
         count(p.site_id) FILTER (WHERE {_DATED}) AS n_valid,
         coalesce(CAST(sum(date_diff('day', p.open_date, DATE '{AS_OF}')) FILTER (WHERE {_DATED}) AS BIGINT), 0) AS sum_days,
         count(p.site_id) FILTER (WHERE {_DATED} AND p.open_date <= DATE '{AS_OF}' - INTERVAL 36 MONTH) AS n_long,
         count(DISTINCT CASE WHEN {_OPEN_NEAR} THEN coalesce(p.sector, '') END) AS n_sectors
  FROM sites s LEFT JOIN pairs2 p ON p.site_id = s.site_id
  GROUP BY s.site_id, s.sector, s.radius_m)""",
    """m AS (
  SELECT *, least(n_same, 100) AS comp,
         CASE WHEN n_valid > 0 THEN sum_days / n_valid ELSE 0e0 END AS avg_d,
         CASE WHEN n_valid > 0 THEN n_long / n_valid ELSE 0e0 END AS ratio
  FROM agg)""",
    """m2 AS (
  SELECT *, least(n_sectors / greatest(comp, 1), 1e0) AS diversity,
         least(avg_d / 3.65e2 * 1e2, 1e2) * 4e-1 + ratio * 1e2 * 3e-1
           + greatest(0e0, 1e2 - least(comp / 2e1 * 1e2, 1e2)) * 2e-1
           + least(n_sectors / greatest(comp, 1), 1e0) * 1e2 * 1e-1 AS score
  FROM m)""",
    """scored AS (
  SELECT site_id, site_sector AS sector, radius_m, n_same, n_all,
         CASE WHEN comp = 0 THEN 5e1 ELSE floor(score * 1e2 + 5e-1) / 1e2 END AS survival_score,
         CASE WHEN comp = 0 THEN 0e0 ELSE floor(avg_d * 1e2 + 5e-1) / 1e2 END AS avg_survival_days,
         CASE WHEN comp = 0 THEN 0e0 ELSE floor(ratio * 1e4 + 5e-1) / 1e2 END AS long_term_ratio_pct,
         CAST(n_same AS BIGINT) AS competition_level,
         CASE WHEN comp = 0 THEN 0e0 ELSE floor(diversity * 1e4 + 5e-1) / 1e2 END AS sector_diversity_pct,
         CASE WHEN comp = 0 THEN 0e0 ELSE diversity END AS div_ratio,
         CASE WHEN comp = 0 THEN 'NO_DATA'
              WHEN score >= 50 AND comp <= 15 AND comp >= 3 AND ratio >= 3e-1 AND diversity >= 3e-1 THEN 'GOOD'
              ELSE concat_ws(',', CASE WHEN score < 50 THEN 'LOW_SURVIVAL' END, CASE WHEN comp > 15 THEN 'CROWDED' END,
                             CASE WHEN comp < 3 THEN 'SPARSE' END, CASE WHEN ratio < 3e-1 THEN 'UNSTABLE' END,
                             CASE WHEN diversity < 3e-1 THEN 'MONOTONE' END) END AS recommendations
  FROM m2)""",
]

SCORE_SQL = with_store_sites("""
SELECT site_id, sector, radius_m, survival_score, avg_survival_days, long_term_ratio_pct,
       competition_level, sector_diversity_pct, recommendations
FROM scored""", *AGG_CTES)


def _sites_stores(spark, sf_dir):
    return customer_sites(spark, sf_dir), store_view(spark, sf_dir)


@register("survival_score", SCORE_SQL)
def q_survival_score(spark, sf_dir):
    s = sc.survival_score(*_sites_stores(spark, sf_dir), AS_OF)
    return s.withColumn("recommendations", F.concat_ws(",", "recommendations"))


def _messages_sql(name: str, mapping: dict) -> str:
    vals = ", ".join(f"('{k}', '{v if isinstance(v, str) else v[1]}')" for k, v in mapping.items())
    return f"{name}(code, message) AS (VALUES {vals})"


@register("survival_recommendations", with_store_sites("""
SELECT x.site_id, 'recommendation' AS kind, CAST(x.pos AS BIGINT) AS pos, x.code, msg.message
FROM (SELECT site_id, unnest(string_split(recommendations, ',')) AS code,
             generate_subscripts(string_split(recommendations, ','), 1) AS pos FROM scored) x
LEFT JOIN msg ON msg.code = x.code""", *AGG_CTES, _messages_sql("msg", sc.SCORE_MESSAGES)))
def q_survival_recommendations(spark, sf_dir):
    return sc.survival_recommendations(sc.survival_score(*_sites_stores(spark, sf_dir), AS_OF))


RATING_CTES = AGG_CTES + ["""rating AS (
  SELECT site_id, sector, radius_m, survival_score,
         CAST(CASE WHEN n_same <= 5 THEN 100 WHEN n_same <= 10 THEN 80 WHEN n_same <= 15 THEN 60
                   WHEN n_same <= 20 THEN 40 ELSE 20 END AS DOUBLE) AS competition_score,
         least(least(n_all, 100) / 3e1 * 1e2, 1e2) AS access, long_term_ratio_pct AS fit,
         CAST(n_all AS BIGINT) AS nearby_stores, CAST(n_same AS BIGINT) AS same_sector_stores,
         avg_survival_days, sector_diversity_pct, div_ratio
  FROM scored)""", """rated AS (
  SELECT *, survival_score * 4e-1 + competition_score * 3e-1 + access * 2e-1 + fit * 1e-1 AS overall
  FROM rating)""", """final AS (
  SELECT site_id, sector, radius_m, floor(overall * 1e2 + 5e-1) / 1e2 AS overall_score, survival_score,
         competition_score, floor(access * 1e2 + 5e-1) / 1e2 AS accessibility_score,
         floor(fit * 1e2 + 5e-1) / 1e2 AS sector_fit_score, nearby_stores, same_sector_stores,
         avg_survival_days, sector_diversity_pct,
         concat_ws(',', CASE WHEN overall >= 80 THEN 'EXCELLENT' WHEN overall >= 60 THEN 'FAVORABLE'
                             WHEN overall >= 40 THEN 'CAUTION' ELSE 'RISKY' END,
                   CASE WHEN same_sector_stores > 20 THEN 'FIERCE_COMPETITION' END) AS recommendations,
         concat_ws(',', CASE WHEN same_sector_stores > 20 THEN 'OVER_COMPETITION' END,
                   CASE WHEN avg_survival_days < 365 THEN 'SHORT_SURVIVAL' END,
                   CASE WHEN nearby_stores < 5 THEN 'UNDEVELOPED' END) AS risk_factors,
         concat_ws(',', CASE WHEN same_sector_stores < 3 THEN 'LOW_COMPETITION' END,
                   CASE WHEN nearby_stores >= 5 THEN 'ACTIVE_AREA' END,
                   CASE WHEN div_ratio > 7e-1 THEN 'DIVERSE_SECTORS' END) AS opportunities
  FROM rated)"""]


@register("site_rating", with_store_sites("SELECT * FROM final", *RATING_CTES))
def q_site_rating(spark, sf_dir):
    r = sc.site_rating(*_sites_stores(spark, sf_dir), AS_OF)
    return r.select(*[F.concat_ws(",", c).alias(c) if c in ("recommendations", "risk_factors", "opportunities")
                      else F.col(c) for c in r.columns])


def _findings_sql() -> str:
    parts = []
    for col, kind, mapping, tone in [("recommendations", "recommendation", sc.RATING_MESSAGES, None),
                                     ("risk_factors", "risk", sc.RISK_MESSAGES, "negative"),
                                     ("opportunities", "opportunity", sc.OPPORTUNITY_MESSAGES, "positive")]:
        vals = ", ".join(
            f"('{k}', '{v if isinstance(v, str) else v[1]}', '{tone or v[0]}')" for k, v in mapping.items())
        parts.append(f"""
SELECT x.site_id, '{kind}' AS kind, CAST(x.pos AS BIGINT) AS pos, x.code, t.message, t.tone
FROM (SELECT site_id, unnest(string_split({col}, ',')) AS code,
             generate_subscripts(string_split({col}, ','), 1) AS pos FROM final WHERE {col} <> '') x
LEFT JOIN (VALUES {vals}) t(code, message, tone) ON t.code = x.code""")
    return "\nUNION ALL".join(parts)


@register("site_rating_findings", with_store_sites(_findings_sql(), *RATING_CTES))
def q_site_rating_findings(spark, sf_dir):
    return sc.site_rating_findings(sc.site_rating(*_sites_stores(spark, sf_dir), AS_OF))


GRID_SITES = """b AS (SELECT CAST(floor(min(lat) * 1e2) AS BIGINT) AS i0, CAST(floor(max(lat) * 1e2) AS BIGINT) AS i1,
                   CAST(floor(min(lng) * 1e2) AS BIGINT) AS j0, CAST(floor(max(lng) * 1e2) AS BIGINT) AS j1
            FROM store WHERE lat IS NOT NULL AND lng IS NOT NULL),
sites AS (SELECT CAST(i * 1000000 + j AS BIGINT) AS site_id, i / 1e2 AS lat, j / 1e2 AS lng, 5e2 AS radius_m,
                 CAST(NULL AS VARCHAR) AS sector
          FROM (SELECT unnest(generate_series(i0, i1)) AS i FROM b) ii,
               (SELECT unnest(generate_series(j0, j1)) AS j FROM b) jj)"""


@register("score_heatmap", with_store("""
SELECT s.site_id, s.lat, s.lng, c.survival_score, c.competition_level,
       CASE WHEN c.survival_score > 70 THEN 'high' WHEN c.survival_score > 40 THEN 'medium' ELSE 'low' END AS score_band,
       CASE WHEN c.competition_level > 20 THEN 'high' WHEN c.competition_level > 10 THEN 'medium' ELSE 'low' END
         AS competition_band
FROM sites s JOIN scored c ON s.site_id = c.site_id""", GRID_SITES, *AGG_CTES))
def q_score_heatmap(spark, sf_dir):
    return sc.score_heatmap(store_view(spark, sf_dir), AS_OF)


SNAPPED_SITES = """snapped AS (SELECT site_id, floor(lat * 1e4 + 5e-1) / 1e4 AS slat, floor(lng * 1e4 + 5e-1) / 1e4 AS slng,
                          radius_m AS sr, sector FROM customer_sites),
sites AS (SELECT DISTINCT CAST(slat AS VARCHAR) || ':' || CAST(slng AS VARCHAR) || ':' || CAST(sr AS VARCHAR)
                 || coalesce(':' || sector, '') AS site_id, slat AS lat, slng AS lng, sr AS radius_m, sector FROM snapped)"""


@register("survival_score_snapped", with_store("""
SELECT n.site_id, c.survival_score, c.avg_survival_days, c.long_term_ratio_pct, c.competition_level,
       c.sector_diversity_pct, c.recommendations
FROM snapped n JOIN scored c
  ON c.site_id = CAST(n.slat AS VARCHAR) || ':' || CAST(n.slng AS VARCHAR) || ':' || CAST(n.sr AS VARCHAR)
                 || coalesce(':' || n.sector, '')""", SITES_SQL.replace("sites AS (", "customer_sites AS (", 1),
    SNAPPED_SITES, *AGG_CTES))
def q_survival_score_snapped(spark, sf_dir):
    s = sc.survival_score_snapped(customer_sites(spark, sf_dir), store_view(spark, sf_dir), AS_OF)
    return s.withColumn("recommendations", F.concat_ws(",", "recommendations"))
