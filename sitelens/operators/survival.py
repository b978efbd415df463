"""Store survival: average lifetime of closed stores, age-stage distribution
of open stores, drop accounting and the keyed merge of precomputed results.

All of these are one ``groupBy(sector)`` with partial (map-side)
aggregation; the sector domain is small, so the final aggregate is tiny even
when one sector holds a third of all rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.dates import as_date, days_between, ntz
from sitelens.functions.numeric import round_half_up

# Survival stages in whole days since opening
# (range name, min day, max day or None, stage label).
STAGES = [
    ("0-1년", 0, 365, "신규 개업"),
    ("1-3년", 366, 1095, "안정화 단계"),
    ("3-5년", 1096, 1825, "성장 단계"),
    ("5-10년", 1826, 3650, "성숙 단계"),
    ("10년 이상", 3651, None, "장기 영업"),
]


def _sector_filter(df: DataFrame, sector: str | None) -> DataFrame:
    return df if not sector else df.filter(F.col("sector") == F.lit(sector))


def closed_durations(stores: DataFrame, sector: str | None = None) -> DataFrame:
    """Closed stores with ``days = close_date - open_date`` (unfiltered)."""
    closed = _sector_filter(stores.filter(F.col("close_date").isNotNull()), sector)
    return closed.select("id", "sector", "open_date", "close_date",
                         days_between(F.col("close_date"), F.col("open_date")).alias("days"))


def survival_by_sector(stores: DataFrame, sector: str | None = None) -> DataFrame:
    """Average days from opening to closing per sector, rows with a missing
    date or a negative duration left out; a NULL sector is its own group."""
    d = closed_durations(stores, sector).filter(F.col("days").isNotNull() & (F.col("days") >= 0))
    return (d.groupBy("sector")
            .agg(round_half_up(F.avg("days")).alias("avg_duration_days"),
                 F.count(F.lit(1)).alias("sample_size")))


def survival_batch(stores: DataFrame) -> DataFrame:
    """The precompute job: as ``survival_by_sector`` but only rows with a
    sector, an opening and a closing date."""
    base = stores.filter(F.col("close_date").isNotNull() & F.col("open_date").isNotNull()
                         & F.col("sector").isNotNull())
    return survival_by_sector(base)


def survival_drops(stores: DataFrame) -> DataFrame:
    """Per sector: closed rows, rows skipped for a missing date, rows skipped
    for a negative duration, rows used."""
    d = closed_durations(stores)
    return (d.groupBy("sector")
            .agg(F.count(F.lit(1)).alias("n_closed"),
                 F.count_if(F.col("days").isNull()).alias("n_missing_date"),
                 F.count_if(F.col("days") < 0).alias("n_negative"),
                 F.count_if(F.col("days") >= 0).alias("n_used")))


def _stage_counts(days: Column) -> list[Column]:
    out = []
    for i, (name, lo, hi, _label) in enumerate(STAGES):
        cond = days >= lo if hi is None else days.between(lo, hi)
        out.append(F.count_if(cond).alias(f"n{i}"))
    return out


def _open_ages(stores: DataFrame, as_of, sector: str | None) -> DataFrame:
    """Open stores with a non-empty sector and an opening not after
    ``as_of``; ``days`` = age in whole days."""
    s = _sector_filter(stores.filter(F.col("close_date").isNull()), sector)
    s = s.filter(F.col("sector").isNotNull() & (F.col("sector") != "") & F.col("open_date").isNotNull())
    s = s.select("sector", days_between(as_date(as_of), F.col("open_date")).alias("days"))
    return s.filter(F.col("days") >= 0)


def _stage_table(stores: DataFrame, as_of, sector: str | None) -> DataFrame:
    ages = _open_ages(stores, as_of, sector)
    return ages.groupBy("sector").agg(F.count(F.lit(1)).alias("total_count"), *_stage_counts(F.col("days")))


def _pct(n: Column, total: Column) -> Column:
    return round_half_up(n / total * F.lit(100.0))


def survival_distribution(stores: DataFrame, as_of: str | _dt.date,
                          sector: str | None = None) -> DataFrame:
    """Nested form: ``sector, stages array<struct<stage,range,count,percentage>>,
    total_count``; all five stages are always present."""
    t = _stage_table(stores, as_of, sector)
    stages = F.array(*[
        F.struct(F.lit(label).alias("stage"), F.lit(name).alias("range"),
                 F.col(f"n{i}").alias("count"), _pct(F.col(f"n{i}"), F.col("total_count")).alias("percentage"))
        for i, (name, _lo, _hi, label) in enumerate(STAGES)])
    return t.select("sector", stages.alias("stages"), "total_count")


def survival_distribution_long(stores: DataFrame, as_of: str | _dt.date,
                               sector: str | None = None) -> DataFrame:
    """Long form of the distribution: one row per (sector, stage)."""
    nested = survival_distribution(stores, as_of, sector)
    return (nested.select("sector", "total_count",
                          F.posexplode("stages").alias("pos", "s"))
            .select("sector", (F.col("pos") + 1).cast("long").alias("stage_order"),
                    F.col("s.stage").alias("stage"), F.col("s.range").alias("range"),
                    F.col("s.count").alias("count"), F.col("s.percentage").alias("percentage"),
                    "total_count"))


def closed_by_sector(stores: DataFrame) -> DataFrame:
    """Closed stores per non-empty sector with the latest closing date (the
    original ordered sectors by first appearance in closing-date-desc order)."""
    c = stores.filter(F.col("close_date").isNotNull() & F.col("sector").isNotNull() & (F.col("sector") != ""))
    return c.groupBy("sector").agg(F.count(F.lit(1)).alias("closed_count"),
                                   F.max("close_date").alias("last_close_date"))


def survival_upsert(existing: DataFrame, batch: DataFrame, run_ts: _dt.datetime) -> DataFrame:
    """Keyed merge of a new batch into the stored survival table.

    New key -> inserted with ``calculated_at = updated_at = run_ts``; existing
    key -> average and size replaced, ``updated_at = run_ts``, the first
    ``calculated_at`` kept; key absent from the batch -> row kept unchanged.
    One full outer join on ``sector`` (one row per sector on each side).
    """
    ts = ntz(run_ts)
    o = existing.alias("o")
    n = batch.alias("n")
    j = o.join(n, F.col("o.sector") == F.col("n.sector"), "full_outer")
    has_new = F.col("n.sector").isNotNull()
    return j.select(
        F.coalesce(F.col("n.sector"), F.col("o.sector")).alias("sector"),
        F.when(has_new, F.col("n.avg_duration_days")).otherwise(F.col("o.avg_duration_days")).alias("avg_duration_days"),
        F.when(has_new, F.col("n.sample_size")).otherwise(F.col("o.sample_size")).alias("sample_size"),
        F.coalesce(F.col("o.calculated_at"), ts).alias("calculated_at"),
        F.when(has_new, ts).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def save_survival(table: DataFrame, folder: str) -> int:
    """Write the merged survival table as the next version of ``folder``
    (a parquet table partitioned by ``version``); earlier versions stay, so
    a lost job leaves the last complete one readable.  Returns the version."""
    stored = load_survival(table.sparkSession, folder, version=True)
    version = 1 if stored is None else stored.agg(F.max("version")).first()[0] + 1
    table.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(folder)
    return version


def load_survival(spark: SparkSession, folder: str, version: bool = False) -> DataFrame | None:
    """The latest version saved in ``folder`` (None before the first save)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    stored = spark.read.parquet(folder)
    latest = stored.agg(F.max("version")).first()[0]
    stored = stored.filter(F.col("version") == latest)
    return stored if version else stored.drop("version")


def survival_table(batch: DataFrame, run_ts: _dt.datetime) -> DataFrame:
    """A fresh stored table from one batch (first run of the precompute)."""
    ts = ntz(run_ts)
    return batch.select("sector", "avg_duration_days", "sample_size",
                        ts.alias("calculated_at"), ts.alias("updated_at"))


def survival_since(stores: DataFrame, min_open_date, sector: str | None = None) -> DataFrame:
    """``survival_by_sector`` over stores opened on or after a date."""
    return survival_by_sector(stores.filter(F.col("open_date") >= as_date(min_open_date)), sector)


def survival_reconcile(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored (precomputed) vs live survival per sector, side by side
    with the differences; a sector missing on one side has NULLs there."""
    s, lv = stored.alias("s"), live.alias("l")
    j = s.join(lv, F.col("s.sector").eqNullSafe(F.col("l.sector")), "full_outer")
    return j.select(F.coalesce(F.col("s.sector"), F.col("l.sector")).alias("sector"),
                    F.col("s.avg_duration_days").alias("stored_avg"), F.col("l.avg_duration_days").alias("live_avg"),
                    F.col("s.sample_size").alias("stored_n"), F.col("l.sample_size").alias("live_n"),
                    round_half_up(F.col("l.avg_duration_days") - F.col("s.avg_duration_days")).alias("avg_diff"),
                    (F.col("l.sample_size") - F.col("s.sample_size")).alias("n_diff"))


def survival_with_fallback(stored: DataFrame, live: DataFrame) -> DataFrame:
    """The stored row where there is one, else the live one
    (``source`` says which)."""
    st = stored.select("sector", "avg_duration_days", "sample_size", F.lit("stored").alias("source"))
    fresh = live.join(stored.select("sector"), "sector", "left_anti") \
                .select("sector", "avg_duration_days", "sample_size", F.lit("live").alias("source"))
    return st.unionByName(fresh)


def survival_lookup(stored: DataFrame, sector: str | None = None) -> DataFrame:
    """Read the stored table, optionally one sector, ordered by sector."""
    return _sector_filter(stored, sector).orderBy("sector")
