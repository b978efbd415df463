"""Openings and closings over time and space.

Every series is an aggregate first (one row per month x key, partial
aggregation map-side); windows (``lag``, running sums) then run over those
few rows per key, never over raw stores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def events(stores: DataFrame) -> DataFrame:
    """One row per opening and per closing: ``id, kind, event_date, sector, lat, lng``."""
    base = stores.select("id", "sector", "lat", "lng", "open_date", "close_date")
    kinds = F.array(F.struct(F.lit("open").alias("kind"), F.col("open_date").alias("event_date")),
                    F.struct(F.lit("close").alias("kind"), F.col("close_date").alias("event_date")))
    return (base.select("id", "sector", "lat", "lng", F.inline(kinds))
            .filter(F.col("event_date").isNotNull()))


def event_heatmap(stores: DataFrame, grid_deg: float = 0.01) -> DataFrame:
    """Openings / closings per month and grid cell."""
    e = events(stores).filter(F.col("lat").isNotNull())
    return (e.groupBy(F.trunc("event_date", "month").alias("month"),
                      F.floor(F.col("lat") / F.lit(grid_deg)).cast("long").alias("cell_lat"),
                      F.floor(F.col("lng") / F.lit(grid_deg)).cast("long").alias("cell_lng"), "kind")
            .agg(F.count(F.lit(1)).alias("n")))


def _monthly(stores: DataFrame, key: str | None) -> DataFrame:
    e = events(stores)
    keys = [key] if key else []
    return e.groupBy(*keys, F.trunc("event_date", "month").alias("month")).agg(
        F.count_if(F.col("kind") == "open").alias("openings"),
        F.count_if(F.col("kind") == "close").alias("closings"))


def _calendar(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Every month between a key's first and last event (gaps filled)."""
    span = monthly.groupBy(*keys).agg(F.min("month").alias("m0"), F.max("month").alias("m1"))
    months = F.explode(F.sequence("m0", "m1", F.expr("INTERVAL 1 MONTH")))
    return span.select(*keys, months.alias("month"))


def activity_series(stores: DataFrame) -> DataFrame:
    """Monthly openings, closings and stores active at month end
    (running sum of openings minus closings)."""
    m = _monthly(stores, None)
    cal = _calendar(m, [])
    s = cal.join(m, "month", "left").fillna(0, ["openings", "closings"])
    # One row per month: the running window is over a short series.
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.select("month", F.col("openings").cast("long").alias("openings"),
                    F.col("closings").cast("long").alias("closings"),
                    F.sum(F.col("openings") - F.col("closings")).over(w).cast("long").alias("active"))


def sector_growth_yearly(stores: DataFrame) -> DataFrame:
    """X14 by year: stores active per sector at every year's end (running sum
    of openings minus closings) and the year-over-year change of that count
    (NULL for the first year or after a year end with none)."""
    e = events(stores.filter(F.col("sector").isNotNull()))
    step = F.when(F.col("kind") == "open", 1).otherwise(-1)
    net = e.groupBy("sector", F.year("event_date").alias("year")).agg(F.sum(step).alias("net"))
    span = net.groupBy("sector").agg(F.min("year").alias("y0"), F.max("year").alias("y1"))
    s = span.select("sector", F.explode(F.sequence("y0", "y1")).alias("year")).join(net, ["sector", "year"], "left")
    by_year = Window.partitionBy("sector").orderBy("year")
    s = s.withColumn("active", F.sum(F.coalesce("net", F.lit(0))).over(by_year.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    prev = F.lag("active").over(by_year)
    return s.select("sector", F.col("year").cast("long").alias("year"), F.col("active").cast("long").alias("active"),
                    prev.cast("long").alias("prev_active"),
                    F.when(prev > 0, (F.col("active") - prev) / prev).alias("growth"))


def sector_growth(stores: DataFrame) -> DataFrame:
    """Monthly openings per sector and month-over-month change
    (``pct_change``: NULL for the first month or after a month with none)."""
    m = _monthly(stores.filter(F.col("sector").isNotNull()), "sector")
    cal = _calendar(m, ["sector"])
    s = cal.join(m, ["sector", "month"], "left").fillna(0, ["openings", "closings"])
    w = Window.partitionBy("sector").orderBy("month")
    prev = F.lag("openings").over(w)
    return s.select("sector", "month", F.col("openings").cast("long").alias("openings"),
                    prev.cast("long").alias("prev_openings"),
                    F.when(prev > 0, (F.col("openings") - prev) / prev).alias("growth"))

