"""Store lists, samples, counts and the opening snapshot.

Ordered lists spell out NULL placement (DESC -> NULLs first, ASC -> NULLs
last, as the original database did) and end with ``id`` so ties are
deterministic.  ``limit`` appears only where a top-k is the feature; Spark
plans ``orderBy().limit(k)`` as TakeOrderedAndProject (per-partition top-k,
then a k-row merge).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.sources.tables import attach_one_row

LATEST_DEFAULT = 50
SAMPLE_SIZE = 10


def _by_open_desc() -> list[Column]:
    return [F.col("open_date").desc_nulls_first(), F.col("id").asc()]


def _sector(df: DataFrame, sector: str | None) -> DataFrame:
    return df if not sector else df.filter(F.col("sector") == F.lit(sector))


def latest_stores(stores: DataFrame, n: int = LATEST_DEFAULT) -> DataFrame:
    """The ``n`` most recently opened stores."""
    return stores.orderBy(*_by_open_desc()).limit(n)


def closed_stores(stores: DataFrame, sector: str | None = None) -> DataFrame:
    """Closed stores (optional sector), newest closing first."""
    return _sector(stores.filter(F.col("close_date").isNotNull()), sector) \
        .orderBy(F.col("close_date").desc_nulls_first(), F.col("id"))


def open_stores(stores: DataFrame, sector: str | None = None) -> DataFrame:
    """Open stores (optional sector), oldest opening first."""
    return _sector(stores.filter(F.col("close_date").isNull()), sector) \
        .orderBy(F.col("open_date").asc_nulls_last(), F.col("id"))


def stores_by_sector(stores: DataFrame, sector: str) -> DataFrame:
    """Every store of one sector, newest opening first."""
    return _sector(stores, sector).orderBy(*_by_open_desc())


def sector_counts(stores: DataFrame) -> DataFrame:
    """Stores per sector, largest first."""
    return stores.groupBy("sector").agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.col("count").desc(), F.col("sector").asc_nulls_last())


def store_sample(stores: DataFrame, n: int = SAMPLE_SIZE) -> DataFrame:
    """``id, store_name, sector`` of the first ``n`` stores by id."""
    return stores.select("id", F.coalesce("store_name", F.lit("")).alias("store_name"), "sector") \
        .orderBy("id").limit(n)


def total_count(stores: DataFrame) -> DataFrame:
    """A16."""
    return stores.agg(F.count(F.lit(1)).alias("total_count"))


def location_coverage(stores: DataFrame) -> DataFrame:
    """Stores with and without coordinates."""
    return stores.agg(F.count(F.lit(1)).alias("total_stores"),
                      F.count("lat").alias("stores_with_location"),
                      F.count_if(F.col("lat").isNull()).alias("stores_without_location"))


def location_sample(stores: DataFrame, n: int = SAMPLE_SIZE) -> DataFrame:
    """E5: ``n`` located stores by id."""
    return stores.filter(F.col("lat").isNotNull()) \
        .select("id", F.coalesce("store_name", F.lit("")).alias("store_name"),
                F.coalesce("sector", F.lit("")).alias("sector"), "lat", "lng") \
        .orderBy("id").limit(n)


def opening_snapshot(stores: DataFrame, n: int = LATEST_DEFAULT) -> DataFrame:
    """A4: over the latest ``n`` stores -- sample size, latest opening date,
    distinct non-empty sectors in order of first appearance.

    Works on at most ``n`` rows after the top-k, so the one-partition window
    and ``collect_list`` are bounded by ``n``.
    """
    top = latest_stores(stores, n).select("id", "sector", "open_date")
    ranked = (top.withColumn("rn", F.row_number().over(Window.orderBy(*_by_open_desc())))
              .withColumn("first_rn", F.min("rn").over(Window.partitionBy("sector"))))
    first_seen = (F.col("rn") == F.col("first_rn")) & F.col("sector").isNotNull() & (F.col("sector") != "")
    out = ranked.agg(F.count(F.lit(1)).alias("sample_size"),
                     F.min_by("open_date", "rn").alias("latest_opened_at"),
                     F.sort_array(F.collect_list(F.when(first_seen, F.struct("rn", "sector")))).alias("s"))
    return out.select(F.col("sample_size").cast("long").alias("sample_size"), "latest_opened_at",
                      F.transform("s", lambda x: x["sector"]).alias("sectors"))


def status_report(stores: DataFrame, sample_n: int = 1000, recent_n: int = LATEST_DEFAULT) -> DataFrame:
    """One row combining the snapshot of the latest ``sample_n`` and
    ``recent_n`` stores, closed stores per sector (newest closing first) and
    location coverage.

    Each part is a one-row aggregate (or a bounded top-k); they are put side
    by side as scalar subqueries.
    """
    snap = opening_snapshot(stores, sample_n).select(
        F.col("sample_size").alias("total_stores_sampled"), F.col("sectors").alias("snapshot_sectors"))
    closed = stores.filter(F.col("close_date").isNotNull())
    by_sector = closed.filter(F.col("sector").isNotNull() & (F.col("sector") != "")) \
        .groupBy("sector").agg(F.count(F.lit(1)).alias("count"), F.max("close_date").alias("last"))
    newest = F.sort_array(F.collect_list(F.struct(F.datediff(F.lit("1970-01-01"), "last").alias("age"), "sector", "count")))
    closed_part = by_sector.agg(F.transform(newest, lambda x: F.struct(x["sector"].alias("sector"), x["count"].alias("count")))
                                .alias("closed_by_sector"))
    totals = stores.agg(F.count("close_date").alias("total_closed_stores"), F.count("lat").alias("stores_with_location"),
                        F.count_if(F.col("lat").isNull()).alias("stores_without_location"),
                        F.least(F.count(F.lit(1)), F.lit(recent_n)).alias("recent_stores"))
    sample = location_sample(stores).agg(F.collect_list(F.struct("id", "lat", "lng", "sector")).alias("sample_locations"))
    out = snap
    for part in (totals, closed_part, sample):
        out = attach_one_row(out, part)
    return out.select(
        F.col("total_stores_sampled").cast("long").alias("total_stores_sampled"),
        F.col("recent_stores").cast("long").alias("recent_stores"), "snapshot_sectors",
        F.col("total_closed_stores").cast("long").alias("total_closed_stores"),
        F.coalesce("closed_by_sector", F.array()).alias("closed_by_sector"),
        F.transform(F.coalesce("closed_by_sector", F.array()), lambda x: x["sector"]).alias("sectors_with_data"),
        F.col("stores_with_location").cast("long").alias("stores_with_location"),
        F.col("stores_without_location").cast("long").alias("stores_without_location"),
        F.array_sort(F.coalesce("sample_locations", F.array())).alias("sample_locations"))


def far_openings(stores: DataFrame, until) -> DataFrame:
    """Stores opened after ``until`` (mistyped years), left out of snapshots up to it."""
    return stores.filter(F.col("open_date") > F.lit(until).cast("date"))


GRAINS = ("day", "week", "month")


def opening_snapshots(stores: DataFrame, n: int = LATEST_DEFAULT, until=None, grain: str = "month") -> DataFrame:
    """The opening snapshot (A4) as of the end of every day, week (Sunday) or
    month between the first and last opening: latest ``n`` stores opened by then.

    Nothing is ranked twice and no period's rows are copied to periods that do
    not show them.  Each period keeps its own top ``n`` (a partial
    ``WindowGroupLimit``, so a period holding a third of all stores is cut
    map-side) and its count.  Running totals over the periods with openings (at
    most one a day of the calendar, whatever the number of stores) then give the
    place of a row in any later snapshot: its place in its own period plus the
    stores opened in the periods between.  A row is sent exactly to the periods
    where that place is at most ``n``.  Periods without openings repeat the
    snapshot before them, made only at the end.  ``until`` leaves later openings
    out (``far_openings`` lists them), so one mistyped year cannot stretch the
    calendar.
    """
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; one of {GRAINS}")
    if until is not None:
        stores = stores.filter(F.col("open_date") <= F.lit(until).cast("date"))
    period = F.col("open_date") if grain == "day" else F.trunc("open_date", grain)
    dated = stores.filter(F.col("open_date").isNotNull()).select("id", "sector", "open_date", period.alias("m"))
    own = Window.partitionBy("m").orderBy(F.col("open_date").desc(), F.col("id").asc())
    top = dated.withColumn("k", F.row_number().over(own)).filter(F.col("k") <= n)

    along = Window.orderBy("m")
    periods = dated.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.max("open_date").alias("latest_opened_at")) \
        .withColumn("total", F.sum("c").over(along.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("next_m", F.lead("m").over(along)) \
        .withColumn("shown", F.collect_list(F.struct("m", "total")).over(along.rowsBetween(0, n - 1)))
    # Each later period opens at least one store, so a row is gone from the snapshots after n periods.
    later = periods.select("m", F.col("total").alias("here"), "shown")
    placed = top.join(later, "m").withColumn("s", F.explode(F.filter("shown", lambda s: s["total"] - F.col("here") + F.col("k") <= n))) \
        .select(F.col("s.m").alias("m"), "sector", (F.col("s.total") - F.col("here") + F.col("k")).alias("rn"))
    first = placed.filter(F.col("sector").isNotNull() & (F.col("sector") != "")) \
        .groupBy("m", "sector").agg(F.min("rn").alias("rn")) \
        .groupBy("m").agg(F.sort_array(F.collect_list(F.struct("rn", "sector"))).alias("s"))
    step = F.expr(f"INTERVAL 1 {grain.upper()}")
    ends = {"day": F.col("p"), "week": F.date_add("p", 6), "month": F.last_day("p")}
    last = F.when(F.col("next_m").isNull(), F.col("m")).otherwise(F.date_sub("next_m", 1))
    return periods.join(first, "m", "left").withColumn("p", F.explode(F.sequence("m", last, step))).select(
        ends[grain].alias("snapshot_date"), F.least(F.col("total"), F.lit(n)).cast("long").alias("sample_size"), "latest_opened_at",
        F.transform(F.coalesce("s", F.array()), lambda x: x["sector"]).alias("sectors"))
