"""Data-quality checks and site validation.

The original cleanup deleted every row with a missing required column (and
with it real closed stores).  Here the table is split instead: every row
stays, tagged valid or rejected with its reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Site validation limits.
LAT_RANGE = (-90.0, 90.0)
LNG_RANGE = (-180.0, 180.0)
RADIUS_RANGE = (1.0, 10000.0)


def _reasons(pairs: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]), lambda x: x.isNotNull())


def _required_missing() -> list[tuple[Column, str]]:
    return [(F.col("sector").isNull(), "SECTOR_NULL"),
            (F.col("open_date").isNull(), "OPEN_DATE_NULL"),
            (F.col("lat").isNull() | F.col("lng").isNull(), "LOCATION_NULL")]


def any_required_null() -> Column:
    c = None
    for cond, _ in _required_missing():
        c = cond if c is None else (c | cond)
    return c


def quality_split(stores: DataFrame) -> DataFrame:
    """K4: all rows with ``status`` ('valid'/'rejected') and ``reject_reasons``."""
    reasons = _reasons(_required_missing())
    return stores.withColumn("reject_reasons", reasons) \
                 .withColumn("status", F.when(F.size("reject_reasons") > 0, "rejected").otherwise("valid"))


def valid_stores(stores: DataFrame) -> DataFrame:
    return quality_split(stores).filter(F.col("status") == "valid").drop("status", "reject_reasons")


def rejected_stores(stores: DataFrame) -> DataFrame:
    return quality_split(stores).filter(F.col("status") == "rejected")


def quality_null_counts(stores: DataFrame) -> DataFrame:
    """NULL count per required column and rows with any of them NULL."""
    return stores.agg(F.count_if(F.col("sector").isNull()).alias("sector_null_count"),
                      F.count_if(F.col("open_date").isNull()).alias("open_date_null_count"),
                      F.count_if(F.col("lat").isNull()).alias("location_null_count"),
                      F.count_if(any_required_null()).alias("total_invalid_count"))


def _flag(c: Column) -> Column:
    return F.when(c.isNull(), "NULL").otherwise("OK")


def quality_sample(stores: DataFrame, n: int = 10) -> DataFrame:
    """``n`` rows (by id) violating a required column, with flags."""
    return stores.filter(any_required_null()).select(
        "id", "store_name", "sector", "open_date", "close_date",
        _flag(F.col("sector")).alias("sector_status"), _flag(F.col("open_date")).alias("open_date_status"),
        _flag(F.col("lat")).alias("location_status")).orderBy("id").limit(n)


def store_status_counts(stores: DataFrame) -> DataFrame:
    """A5/A10: total, closed, open, closed without / with location."""
    closed = F.col("close_date").isNotNull()
    return stores.agg(F.count(F.lit(1)).alias("total_stores"),
                      F.count_if(closed).alias("closed_stores"),
                      F.count_if(~closed).alias("open_stores"),
                      F.count_if(closed & F.col("lat").isNull()).alias("closed_stores_without_location"),
                      F.count_if(closed & F.col("lat").isNotNull()).alias("closed_stores_with_location"))


def sector_status(stores: DataFrame) -> DataFrame:
    """A6 per sector (all sectors; ``sector_status_top`` keeps the top k)."""
    closed = F.col("close_date").isNotNull()
    return stores.groupBy("sector").agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(closed).alias("closed_count"),
        F.count_if(closed & F.col("lat").isNull()).alias("closed_without_location"),
        F.count_if(closed & F.col("lat").isNotNull()).alias("closed_with_location"))


def sector_status_top(stores: DataFrame, k: int = 20) -> DataFrame:
    return sector_status(stores).orderBy(F.col("closed_count").desc(), F.col("sector").asc_nulls_last()).limit(k)


def closed_sample(stores: DataFrame, sector: str, n: int = 10) -> DataFrame:
    """Newest ``n`` closed stores of one sector with a location flag."""
    return stores.filter((F.col("sector") == F.lit(sector)) & F.col("close_date").isNotNull()).select(
        "id", "store_name", "sector", "open_date", "close_date",
        _flag(F.col("lat")).alias("location_status"), "address") \
        .orderBy(F.col("close_date").desc_nulls_first(), F.col("id")).limit(n)


def closed_unlocated(stores: DataFrame) -> DataFrame:
    """A8 (the redundant any-null predicate of the original is kept)."""
    c = F.col("close_date").isNotNull() & F.col("lat").isNull() & any_required_null()
    return stores.agg(F.count_if(c).alias("deleted_closed_stores_count"))


def site_validation(sites: DataFrame) -> DataFrame:
    """Every site with ``reject_reasons`` and ``is_valid``."""
    lat, lng, r, sec = F.col("lat"), F.col("lng"), F.col("radius_m"), F.col("sector")
    reasons = _reasons([
        (lat.isNull() | (lat < LAT_RANGE[0]) | (lat > LAT_RANGE[1]), "LAT_OUT_OF_RANGE"),
        (lng.isNull() | (lng < LNG_RANGE[0]) | (lng > LNG_RANGE[1]), "LNG_OUT_OF_RANGE"),
        (r.isNull() | (r < RADIUS_RANGE[0]) | (r > RADIUS_RANGE[1]), "RADIUS_OUT_OF_RANGE"),
        (sec.isNotNull() & (F.trim(sec) == ""), "SECTOR_BLANK"),
    ])
    return sites.withColumn("reject_reasons", reasons).withColumn("is_valid", F.size("reject_reasons") == 0)


def rejected_sites(sites: DataFrame) -> DataFrame:
    """The sites that fail validation, with their reasons.  Distance operators match no store to a
    site that is not on Earth or has no usable radius, and make no cells for it."""
    return site_validation(sites).filter(~F.col("is_valid")).drop("is_valid")
