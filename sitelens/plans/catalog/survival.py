"""Survival family: A1, A2, A3 (+ long form), A11, A12, K2, X17-X20."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import survival as sv
from sitelens.plans.catalog.common import (AS_OF, PREVIOUS_RUN_CUTOFF, RUN_TS_NEW, RUN_TS_OLD,
                                           with_store)
from sitelens.plans.registry import register
from sitelens.sources.store_view import store_view

R2 = "floor({x} * 1e2 + 5e-1) / 1e2"

DAYS_CLOSED = "date_diff('day', open_date, close_date)"


@register("survival_by_sector", with_store(f"""
SELECT sector, {R2.format(x=f'avg({DAYS_CLOSED})')} AS avg_duration_days, count(*) AS sample_size
FROM store
WHERE close_date IS NOT NULL AND open_date IS NOT NULL AND {DAYS_CLOSED} >= 0
GROUP BY sector"""))
def q_survival_by_sector(spark, sf_dir):
    return sv.survival_by_sector(store_view(spark, sf_dir))


@register("survival_by_sector_one", with_store(f"""
SELECT sector, {R2.format(x=f'avg({DAYS_CLOSED})')} AS avg_duration_days, count(*) AS sample_size
FROM store
WHERE close_date IS NOT NULL AND open_date IS NOT NULL AND {DAYS_CLOSED} >= 0 AND sector = 'BUILDING'
GROUP BY sector"""))
def q_survival_by_sector_one(spark, sf_dir):
    return sv.survival_by_sector(store_view(spark, sf_dir), sector="BUILDING")


BATCH_SQL = f"""
SELECT sector, {R2.format(x=f'avg({DAYS_CLOSED})')} AS avg_duration_days, count(*) AS sample_size
FROM store
WHERE close_date IS NOT NULL AND open_date IS NOT NULL AND sector IS NOT NULL AND {DAYS_CLOSED} >= 0 {{extra}}
GROUP BY sector"""


@register("survival_batch", with_store(BATCH_SQL.format(extra="")))
def q_survival_batch(spark, sf_dir):
    return sv.survival_batch(store_view(spark, sf_dir))


@register("survival_drops", with_store(f"""
SELECT sector, count(*) AS n_closed,
       count(*) FILTER (WHERE {DAYS_CLOSED} IS NULL) AS n_missing_date,
       count(*) FILTER (WHERE {DAYS_CLOSED} < 0) AS n_negative,
       count(*) FILTER (WHERE {DAYS_CLOSED} >= 0) AS n_used
FROM store WHERE close_date IS NOT NULL GROUP BY sector"""))
def q_survival_drops(spark, sf_dir):
    return sv.survival_drops(store_view(spark, sf_dir))


def _stage_sql() -> str:
    rows = []
    for i, (name, lo, hi, label) in enumerate(sv.STAGES):
        hi_sql = "NULL" if hi is None else str(hi)
        rows.append(f"({i + 1}, '{label}', '{name}', {lo}, {hi_sql})")
    return ("stages(stage_order, stage, range, lo, hi) AS (VALUES " + ", ".join(rows) + ")")


DIST_SQL = with_store(f"""
SELECT a.sector, CAST(st.stage_order AS BIGINT) AS stage_order, st.stage, st.range,
       count(a.days) FILTER (WHERE a.days >= st.lo AND (st.hi IS NULL OR a.days <= st.hi)) AS count,
       floor(count(a.days) FILTER (WHERE a.days >= st.lo AND (st.hi IS NULL OR a.days <= st.hi))
             / t.total_count * 1e2 * 1e2 + 5e-1) / 1e2 AS percentage,
       t.total_count
FROM ages a
JOIN totals t ON a.sector = t.sector
CROSS JOIN stages st
GROUP BY a.sector, st.stage_order, st.stage, st.range, t.total_count""", f"""
ages AS (SELECT sector, date_diff('day', open_date, DATE '{AS_OF}') AS days FROM store
         WHERE close_date IS NULL AND sector IS NOT NULL AND sector <> '' AND open_date IS NOT NULL
           AND date_diff('day', open_date, DATE '{AS_OF}') >= 0)""",
    "totals AS (SELECT sector, count(*) AS total_count FROM ages GROUP BY sector)",
    _stage_sql())


@register("survival_distribution_long", DIST_SQL)
def q_survival_distribution_long(spark, sf_dir):
    return sv.survival_distribution_long(store_view(spark, sf_dir), AS_OF)


@register("survival_distribution", f"""
SELECT sector, string_agg(stage || '|' || range || '|' || CAST(count AS VARCHAR) || '|' ||
                          CAST(CAST(floor(percentage * 1e2 + 5e-1) AS BIGINT) AS VARCHAR), ';' ORDER BY stage_order) AS stages,
       max(total_count) AS total_count
FROM ({DIST_SQL}) d GROUP BY sector""")
def q_survival_distribution(spark, sf_dir):
    # The nested stages as text: stage|range|count|hundredths of a percent, in stage order.
    d = sv.survival_distribution(store_view(spark, sf_dir), AS_OF)
    text = F.transform("stages", lambda s: F.concat_ws(
        "|", s["stage"], s["range"], s["count"].cast("string"),
        F.floor(s["percentage"] * F.lit(100.0) + F.lit(0.5)).cast("long").cast("string")))
    return d.select("sector", F.array_join(text, ";").alias("stages"), "total_count")


@register("closed_by_sector", with_store("""
SELECT sector, count(*) AS closed_count, max(close_date) AS last_close_date
FROM store WHERE close_date IS NOT NULL AND sector IS NOT NULL AND sector <> ''
GROUP BY sector"""))
def q_closed_by_sector(spark, sf_dir):
    return sv.closed_by_sector(store_view(spark, sf_dir))


def _ts_sql(ts) -> str:
    return f"TIMESTAMP '{ts:%Y-%m-%d %H:%M:%S}'"


@register("survival_upsert", with_store(f"""
SELECT coalesce(n.sector, o.sector) AS sector,
       CASE WHEN n.sector IS NOT NULL THEN n.avg_duration_days ELSE o.avg_duration_days END AS avg_duration_days,
       CASE WHEN n.sector IS NOT NULL THEN n.sample_size ELSE o.sample_size END AS sample_size,
       coalesce(o.calculated_at, {_ts_sql(RUN_TS_NEW)}) AS calculated_at,
       CASE WHEN n.sector IS NOT NULL THEN {_ts_sql(RUN_TS_NEW)} ELSE o.updated_at END AS updated_at
FROM old o FULL OUTER JOIN new n ON o.sector = n.sector""",
    f"""old AS (SELECT sector, avg_duration_days, sample_size, {_ts_sql(RUN_TS_OLD)} AS calculated_at,
                      {_ts_sql(RUN_TS_OLD)} AS updated_at
               FROM ({BATCH_SQL.format(extra=f"AND close_date < DATE '{PREVIOUS_RUN_CUTOFF}'")}) b)""",
    f"new AS ({BATCH_SQL.format(extra='')})"))
def q_survival_upsert(spark, sf_dir):
    stores = store_view(spark, sf_dir)
    # The stored table as the previous run left it: only closings known then.
    previous = sv.survival_table(
        sv.survival_batch(stores.filter(F.col("close_date") < F.lit(PREVIOUS_RUN_CUTOFF).cast("date"))),
        RUN_TS_OLD)
    return sv.survival_upsert(previous, sv.survival_batch(stores), RUN_TS_NEW)


@register("survival_since", with_store(f"""
SELECT sector, {R2.format(x=f'avg({DAYS_CLOSED})')} AS avg_duration_days, count(*) AS sample_size
FROM store
WHERE close_date IS NOT NULL AND open_date IS NOT NULL AND {DAYS_CLOSED} >= 0 AND open_date >= DATE '1997-01-01'
GROUP BY sector"""))
def q_survival_since(spark, sf_dir):
    return sv.survival_since(store_view(spark, sf_dir), "1997-01-01")


# The stored table as the previous run (closings before the cutoff) left it.
_BEFORE_CUTOFF = f"AND close_date < DATE '{PREVIOUS_RUN_CUTOFF}'"
STORED_CTE = f"stored AS ({BATCH_SQL.format(extra=_BEFORE_CUTOFF)})"
LIVE_CTE = f"live AS ({BATCH_SQL.format(extra='')})"


def _stored_live(spark, sf_dir):
    stores = store_view(spark, sf_dir)
    stored = sv.survival_batch(stores.filter(F.col("close_date") < F.lit(PREVIOUS_RUN_CUTOFF).cast("date")))
    return stored, sv.survival_batch(stores)


@register("survival_reconcile", with_store("""
SELECT coalesce(s.sector, l.sector) AS sector, s.avg_duration_days AS stored_avg, l.avg_duration_days AS live_avg,
       s.sample_size AS stored_n, l.sample_size AS live_n,
       floor((l.avg_duration_days - s.avg_duration_days) * 1e2 + 5e-1) / 1e2 AS avg_diff,
       l.sample_size - s.sample_size AS n_diff
FROM stored s FULL OUTER JOIN live l ON s.sector IS NOT DISTINCT FROM l.sector""", STORED_CTE, LIVE_CTE))
def q_survival_reconcile(spark, sf_dir):
    return sv.survival_reconcile(*_stored_live(spark, sf_dir))


@register("survival_with_fallback", with_store("""
SELECT sector, avg_duration_days, sample_size, 'stored' AS source FROM stored
UNION ALL
SELECT sector, avg_duration_days, sample_size, 'live' AS source FROM live
WHERE sector NOT IN (SELECT sector FROM stored)""", STORED_CTE, LIVE_CTE))
def q_survival_with_fallback(spark, sf_dir):
    return sv.survival_with_fallback(*_stored_live(spark, sf_dir))


@register("survival_lookup", with_store("SELECT * FROM stored WHERE sector = 'FURNITURE'", STORED_CTE))
def q_survival_lookup(spark, sf_dir):
    return sv.survival_lookup(_stored_live(spark, sf_dir)[0], "FURNITURE")
