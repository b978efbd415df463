"""Lists, samples, counts, snapshot, status report and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import quality as qa
from sitelens.operators import stores as so
from sitelens.plans.catalog.common import AS_OF, with_store
from sitelens.plans.registry import register
from sitelens.sources.tables import read_table
from sitelens.sources.store_view import store_view

ALL = "id, store_name, sector, address, open_date, close_date, lat, lng"


def _v(spark, sf_dir):
    return store_view(spark, sf_dir)


@register("latest_stores", with_store(f"SELECT {ALL} FROM store ORDER BY open_date DESC NULLS FIRST, id LIMIT 50"))
def q_latest_stores(spark, sf_dir):
    return so.latest_stores(_v(spark, sf_dir), 50)


@register("closed_stores", with_store(f"SELECT {ALL} FROM store WHERE close_date IS NOT NULL"))
def q_closed_stores(spark, sf_dir):
    return so.closed_stores(_v(spark, sf_dir))


@register("closed_stores_sector",
          with_store(f"SELECT {ALL} FROM store WHERE close_date IS NOT NULL AND sector = 'AUTOMOBILE'"))
def q_closed_stores_sector(spark, sf_dir):
    return so.closed_stores(_v(spark, sf_dir), "AUTOMOBILE")


@register("open_stores", with_store(f"SELECT {ALL} FROM store WHERE close_date IS NULL"))
def q_open_stores(spark, sf_dir):
    return so.open_stores(_v(spark, sf_dir))


@register("open_stores_sector", with_store(f"SELECT {ALL} FROM store WHERE close_date IS NULL AND sector = 'HOUSEHOLD'"))
def q_open_stores_sector(spark, sf_dir):
    return so.open_stores(_v(spark, sf_dir), "HOUSEHOLD")


@register("stores_by_sector", with_store(f"SELECT {ALL} FROM store WHERE sector = 'BUILDING'"))
def q_stores_by_sector(spark, sf_dir):
    return so.stores_by_sector(_v(spark, sf_dir), "BUILDING")


@register("sector_counts", with_store("SELECT sector, count(*) AS count FROM store GROUP BY sector"))
def q_sector_counts(spark, sf_dir):
    return so.sector_counts(_v(spark, sf_dir))


@register("store_sample", with_store(
    "SELECT id, coalesce(store_name, '') AS store_name, sector FROM store ORDER BY id LIMIT 10"))
def q_store_sample(spark, sf_dir):
    return so.store_sample(_v(spark, sf_dir))


@register("total_count", with_store("SELECT count(*) AS total_count FROM store"))
def q_total_count(spark, sf_dir):
    return so.total_count(_v(spark, sf_dir))


@register("location_coverage", with_store("""
SELECT count(*) AS total_stores, count(lat) AS stores_with_location,
       count(*) FILTER (WHERE lat IS NULL) AS stores_without_location FROM store"""))
def q_location_coverage(spark, sf_dir):
    return so.location_coverage(_v(spark, sf_dir))


@register("location_sample", with_store("""
SELECT id, coalesce(store_name, '') AS store_name, coalesce(sector, '') AS sector, lat, lng
FROM store WHERE lat IS NOT NULL ORDER BY id LIMIT 10"""))
def q_location_sample(spark, sf_dir):
    return so.location_sample(_v(spark, sf_dir))


def _snapshot_sql(n: int) -> str:
    return with_store(f"""
SELECT CAST(count(*) AS BIGINT) AS sample_size,
       (SELECT open_date FROM top WHERE rn = 1) AS latest_opened_at,
       coalesce((SELECT string_agg(sector, '|' ORDER BY first_rn) FROM
                   (SELECT sector, min(rn) AS first_rn FROM top WHERE sector IS NOT NULL AND sector <> ''
                    GROUP BY sector) f), '') AS sectors
FROM top""", f"""top AS (SELECT id, sector, open_date,
                  row_number() OVER (ORDER BY open_date DESC NULLS FIRST, id) AS rn
           FROM store ORDER BY open_date DESC NULLS FIRST, id LIMIT {n})""")


@register("opening_snapshot", _snapshot_sql(50))
def q_opening_snapshot(spark, sf_dir):
    return so.opening_snapshot(_v(spark, sf_dir), 50).withColumn("sectors", F.concat_ws("|", "sectors"))


@register("opening_snapshot_1000", _snapshot_sql(1000))
def q_opening_snapshot_1000(spark, sf_dir):
    return so.opening_snapshot(_v(spark, sf_dir), 1000).withColumn("sectors", F.concat_ws("|", "sectors"))


@register("status_report", with_store("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM top) AS total_stores_sampled,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM store ORDER BY open_date DESC NULLS FIRST, id LIMIT 50) r)
         AS recent_stores,
       coalesce((SELECT string_agg(sector, '|' ORDER BY first_rn) FROM
                   (SELECT sector, min(rn) AS first_rn FROM top WHERE sector IS NOT NULL AND sector <> ''
                    GROUP BY sector) f), '') AS snapshot_sectors,
       (SELECT count(*) FROM store WHERE close_date IS NOT NULL) AS total_closed_stores,
       coalesce((SELECT string_agg(sector || ':' || n, '|' ORDER BY last DESC, sector) FROM
                   (SELECT sector, count(*) AS n, max(close_date) AS last FROM store WHERE close_date IS NOT NULL AND sector IS NOT NULL
                    AND sector <> '' GROUP BY sector) c), '') AS closed_by_sector,
       (SELECT count(lat) FROM store) AS stores_with_location,
       (SELECT count(*) FROM store WHERE lat IS NULL) AS stores_without_location,
       (SELECT string_agg(CAST(id AS VARCHAR), '|' ORDER BY id) FROM
          (SELECT id FROM store WHERE lat IS NOT NULL ORDER BY id LIMIT 10) s) AS sample_ids""",
    """top AS (SELECT id, sector, open_date,
                  row_number() OVER (ORDER BY open_date DESC NULLS FIRST, id) AS rn
           FROM store ORDER BY open_date DESC NULLS FIRST, id LIMIT 1000)"""))
def q_status_report(spark, sf_dir):
    r = so.status_report(_v(spark, sf_dir))
    return r.select(
        "total_stores_sampled", "recent_stores", F.concat_ws("|", "snapshot_sectors").alias("snapshot_sectors"),
        "total_closed_stores",
        F.concat_ws("|", F.transform("closed_by_sector", lambda x: F.concat(x["sector"], F.lit(":"),
                                                                              x["count"].cast("string"))))
        .alias("closed_by_sector"),
        "stores_with_location", "stores_without_location",
        F.concat_ws("|", F.transform("sample_locations", lambda x: x["id"].cast("string"))).alias("sample_ids"))


REQ_NULL = "(sector IS NULL OR open_date IS NULL OR lat IS NULL OR lng IS NULL)"


@register("quality_split", with_store(f"""
SELECT {ALL},
       concat_ws(',', CASE WHEN sector IS NULL THEN 'SECTOR_NULL' END,
                      CASE WHEN open_date IS NULL THEN 'OPEN_DATE_NULL' END,
                      CASE WHEN lat IS NULL OR lng IS NULL THEN 'LOCATION_NULL' END) AS reject_reasons,
       CASE WHEN {REQ_NULL} THEN 'rejected' ELSE 'valid' END AS status
FROM store"""))
def q_quality_split(spark, sf_dir):
    return qa.quality_split(_v(spark, sf_dir)).withColumn("reject_reasons", F.concat_ws(",", "reject_reasons"))


@register("quality_null_counts", with_store(f"""
SELECT count(*) FILTER (WHERE sector IS NULL) AS sector_null_count,
       count(*) FILTER (WHERE open_date IS NULL) AS open_date_null_count,
       count(*) FILTER (WHERE lat IS NULL) AS location_null_count,
       count(*) FILTER (WHERE {REQ_NULL}) AS total_invalid_count FROM store"""))
def q_quality_null_counts(spark, sf_dir):
    return qa.quality_null_counts(_v(spark, sf_dir))


@register("quality_sample", with_store(f"""
SELECT id, store_name, sector, open_date, close_date,
       CASE WHEN sector IS NULL THEN 'NULL' ELSE 'OK' END AS sector_status,
       CASE WHEN open_date IS NULL THEN 'NULL' ELSE 'OK' END AS open_date_status,
       CASE WHEN lat IS NULL THEN 'NULL' ELSE 'OK' END AS location_status
FROM store WHERE {REQ_NULL} ORDER BY id LIMIT 10"""))
def q_quality_sample(spark, sf_dir):
    return qa.quality_sample(_v(spark, sf_dir))


@register("store_status_counts", with_store("""
SELECT count(*) AS total_stores, count(*) FILTER (WHERE close_date IS NOT NULL) AS closed_stores,
       count(*) FILTER (WHERE close_date IS NULL) AS open_stores,
       count(*) FILTER (WHERE close_date IS NOT NULL AND lat IS NULL) AS closed_stores_without_location,
       count(*) FILTER (WHERE close_date IS NOT NULL AND lat IS NOT NULL) AS closed_stores_with_location
FROM store"""))
def q_store_status_counts(spark, sf_dir):
    return qa.store_status_counts(_v(spark, sf_dir))


@register("sector_status_top20", with_store("""
SELECT sector, count(*) AS total_count, count(*) FILTER (WHERE close_date IS NOT NULL) AS closed_count,
       count(*) FILTER (WHERE close_date IS NOT NULL AND lat IS NULL) AS closed_without_location,
       count(*) FILTER (WHERE close_date IS NOT NULL AND lat IS NOT NULL) AS closed_with_location
FROM store GROUP BY sector ORDER BY closed_count DESC, sector ASC NULLS LAST LIMIT 20"""))
def q_sector_status_top20(spark, sf_dir):
    return qa.sector_status_top(_v(spark, sf_dir), 20)


@register("closed_sample", with_store("""
SELECT id, store_name, sector, open_date, close_date,
       CASE WHEN lat IS NULL THEN 'NULL' ELSE 'OK' END AS location_status, address
FROM store WHERE sector = 'MACHINERY' AND close_date IS NOT NULL
ORDER BY close_date DESC NULLS FIRST, id LIMIT 10"""))
def q_closed_sample(spark, sf_dir):
    return qa.closed_sample(_v(spark, sf_dir), "MACHINERY")


@register("closed_unlocated", with_store(f"""
SELECT count(*) FILTER (WHERE close_date IS NOT NULL AND lat IS NULL AND {REQ_NULL}) AS deleted_closed_stores_count
FROM store"""))
def q_closed_unlocated(spark, sf_dir):
    return qa.closed_unlocated(_v(spark, sf_dir))


# Site requests as a caller would send them: one per customer, the account
# balance read as the radius (so some fall outside 1..10000 m).
@register("site_validation", """
SELECT c_custkey AS site_id, 3.748e1 + ((c_custkey * 7727) % 11987) / 1e5 AS lat,
       1.269e2 + ((c_custkey * 6007) % 19997) / 1e5 AS lng, c_acctbal AS radius_m, c_mktsegment AS sector,
       concat_ws(',', CASE WHEN c_acctbal < 1e0 OR c_acctbal > 1e4 THEN 'RADIUS_OUT_OF_RANGE' END) AS reject_reasons,
       NOT (c_acctbal < 1e0 OR c_acctbal > 1e4) AS is_valid
FROM customer""")
def q_site_validation(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    k = F.col("c_custkey")
    req = c.select(k.alias("site_id"),
                   (F.lit(37.48) + ((k * 7727) % 11987) / F.lit(1e5)).alias("lat"),
                   (F.lit(126.9) + ((k * 6007) % 19997) / F.lit(1e5)).alias("lng"),
                   F.col("c_acctbal").alias("radius_m"), F.col("c_mktsegment").alias("sector"))
    return qa.site_validation(req).withColumn("reject_reasons", F.concat_ws(",", "reject_reasons"))


_SNAPSHOT_END = {"day": "CAST(m AS DATE)", "week": "CAST(m AS DATE) + 6", "month": "CAST(last_day(CAST(m AS DATE)) AS DATE)"}


def _snapshots_sql(grain: str, until: str | None = None) -> str:
    known = "open_date IS NOT NULL" + (f" AND open_date <= DATE '{until}'" if until else "")
    return with_store(f"""
SELECT snapshot_date, CAST(count(*) AS BIGINT) AS sample_size, max(open_date) AS latest_opened_at,
       coalesce(string_agg(CASE WHEN rn = first_rn AND sector IS NOT NULL AND sector <> '' THEN sector END, '|'
                           ORDER BY rn), '') AS sectors
FROM (SELECT *, min(rn) OVER (PARTITION BY snapshot_date, sector) AS first_rn FROM (
        SELECT d.snapshot_date, s.id, s.sector, s.open_date,
               row_number() OVER (PARTITION BY d.snapshot_date ORDER BY s.open_date DESC, s.id) AS rn
        FROM days d JOIN store s ON {known.replace("open_date", "s.open_date")} AND s.open_date <= d.snapshot_date) x
      WHERE rn <= 50) y
GROUP BY snapshot_date""", f"""days AS (
  SELECT {_SNAPSHOT_END[grain]} AS snapshot_date
  FROM (SELECT unnest(generate_series(date_trunc('{grain}', min(open_date)), date_trunc('{grain}', max(open_date)),
                                      INTERVAL 1 {grain.upper()})) AS m FROM store WHERE {known}) g)""")


@register("opening_snapshots_monthly", _snapshots_sql("month"))
def q_opening_snapshots_monthly(spark, sf_dir):
    return so.opening_snapshots(_v(spark, sf_dir), 50).withColumn("sectors", F.concat_ws("|", "sectors"))


@register("opening_snapshots_weekly", _snapshots_sql("week", AS_OF))
def q_opening_snapshots_weekly(spark, sf_dir):
    return so.opening_snapshots(_v(spark, sf_dir), 50, until=AS_OF, grain="week").withColumn("sectors", F.concat_ws("|", "sectors"))


@register("opening_snapshots_daily", _snapshots_sql("day", AS_OF))
def q_opening_snapshots_daily(spark, sf_dir):
    return so.opening_snapshots(_v(spark, sf_dir), 50, until=AS_OF, grain="day").withColumn("sectors", F.concat_ws("|", "sectors"))


@register("closed_scan", with_store("""
SELECT sector, open_date, close_date FROM store
WHERE close_date IS NOT NULL AND open_date IS NOT NULL AND sector IS NOT NULL"""))
def q_closed_scan(spark, sf_dir):
    """The batch job's input scan (closed, dated, with a sector)."""
    s = _v(spark, sf_dir)
    return s.filter(F.col("close_date").isNotNull() & F.col("open_date").isNotNull() & F.col("sector").isNotNull()) \
            .select("sector", "open_date", "close_date")


@register("clean_dates", with_store("""
SELECT id, raw,
       CASE WHEN regexp_full_match(regexp_replace(raw, '[/\\- ]', '', 'g'), '[0-9]{8}')
            THEN CAST(try_strptime(regexp_replace(raw, '[/\\- ]', '', 'g'), '%Y%m%d') AS DATE) END AS open_date
FROM (SELECT id,
             CASE WHEN id % 7 = 0 THEN strftime(open_date, '%Y%m') || '32'
                  WHEN id % 3 = 0 THEN strftime(open_date, '%Y%m%d')
                  WHEN id % 3 = 1 THEN strftime(open_date, '%Y-%m-%d')
                  ELSE strftime(open_date, '%Y/%m/%d') END AS raw
      FROM store) t"""))
def q_clean_dates(spark, sf_dir):
    """P2 over permit-style text derived from every store's opening date:
    three layouts (by id % 3) and an impossible day every 7th row."""
    from sitelens.functions.dates import parse_permit_date
    s = _v(spark, sf_dir)
    raw = (F.when(F.col("id") % 7 == 0, F.concat(F.date_format("open_date", "yyyyMM"), F.lit("32")))
           .when(F.col("id") % 3 == 0, F.date_format("open_date", "yyyyMMdd"))
           .when(F.col("id") % 3 == 1, F.date_format("open_date", "yyyy-MM-dd"))
           .otherwise(F.date_format("open_date", "yyyy/MM/dd")))
    t = s.select("id", raw.alias("raw"))
    return t.select("id", "raw", parse_permit_date(F.col("raw")).alias("open_date"))


@register("clean_permit_text", with_store("""
SELECT id, store_name, sector, address,
       CASE WHEN regexp_full_match(regexp_replace(o, '[/\\- ]', '', 'g'), '[0-9]{8}')
            THEN CAST(try_strptime(regexp_replace(o, '[/\\- ]', '', 'g'), '%Y%m%d') AS DATE) END AS open_date,
       CASE WHEN regexp_full_match(regexp_replace(c, '[/\\- ]', '', 'g'), '[0-9]{8}')
            THEN CAST(try_strptime(regexp_replace(c, '[/\\- ]', '', 'g'), '%Y%m%d') AS DATE) END AS close_date,
       CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng
FROM (SELECT id, store_name, sector, address, strftime(open_date, '%Y%m%d') AS o,
             strftime(close_date, '%Y-%m-%d') AS c FROM store) t
WHERE store_name IS NOT NULL AND trim(store_name) <> '' AND address IS NOT NULL AND trim(address) <> ''"""))
def q_clean_permit_text(spark, sf_dir):
    """P1-P5 on permit-style text (Korean column names) derived from every
    store row: opening as ``yyyyMMdd``, closing as ``yyyy-MM-dd``."""
    from sitelens.sources.permits import COLUMN_NAMES, clean_columns
    permit_name = {v: k for k, v in COLUMN_NAMES.items()}
    s = _v(spark, sf_dir)
    text = {"store_name": F.col("store_name"), "sector": F.col("sector"), "address": F.col("address"),
            "open_date": F.date_format("open_date", "yyyyMMdd"), "close_date": F.date_format("close_date", "yyyy-MM-dd")}
    raw = s.select("id", *[c.alias(permit_name[k]) for k, c in text.items()])
    return clean_columns(raw, keep=("id",))
