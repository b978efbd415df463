"""Nearest-N stores per site."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.operators import nearest as nn
from sitelens.plans.catalog.common import with_store, with_store_sites
from sitelens.plans.registry import register
from sitelens.sources.sites import customer_sites
from sitelens.sources.store_view import store_view
from sitelens.sources.tables import read_table

D = geo.distance_sql("global", "s.lat", "s.lng", "st.lat", "st.lng")


NEAREST_SQL = f"""
SELECT site_id, rank, id, sector, floor(d * 1e2 + 5e-1) / 1e2 AS distance_m FROM (
  SELECT s.site_id, st.id, st.sector, {D} AS d,
         CAST(row_number() OVER (PARTITION BY s.site_id ORDER BY {D}, st.id) AS BIGINT) AS rank
  FROM sites s JOIN store st ON st.lat IS NOT NULL AND st.lng IS NOT NULL
  WHERE s.sector IS NULL OR s.sector = st.sector) t
WHERE rank <= 5"""


@register("nearest_stores", with_store_sites(NEAREST_SQL))
def q_nearest_stores(spark, sf_dir):
    return nn.nearest_stores(customer_sites(spark, sf_dir), store_view(spark, sf_dir), n=5)


# One site per supplier anywhere on Earth, most of them thousands of kilometres from any store.
FAR_SITES_SQL = """sites AS (
  SELECT CAST(s_suppkey AS BIGINT) AS site_id, -6e1 + ((s_suppkey * 37) % 1201) / 1e1 AS lat,
         -1.8e2 + ((s_suppkey * 97) % 3600) / 1e1 AS lng,
         CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' END AS sector
  FROM supplier)"""


@register("nearest_stores_far", with_store(NEAREST_SQL, FAR_SITES_SQL))
def q_nearest_stores_far(spark, sf_dir):
    k = F.col("s_suppkey")
    sites = read_table(spark, sf_dir, "supplier", ["s_suppkey"]).select(
        k.cast("long").alias("site_id"), (F.lit(-60.0) + ((k * 37) % 1201) / F.lit(10.0)).alias("lat"),
        (F.lit(-180.0) + ((k * 97) % 3600) / F.lit(10.0)).alias("lng"),
        F.when(k % 3 == 0, "BUILDING").when(k % 3 == 1, "MACHINERY").alias("sector"))
    return nn.nearest_stores(sites, store_view(spark, sf_dir), n=5)
