"""Schemas of the stored tables (K5) and DDL to create them.

``store``                  the shop table (derived by ``store_view`` or ingested);
``survival_analysis``      precomputed survival per sector (keyed by sector);
``store_opening_snapshot`` specified in the design notes, never created there;
``sites`` / ``address_coords``  inputs of the spatial and enrichment jobs.

The sector key is a plain string: the original ``varchar(10)`` key was too
narrow for real sector names.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.dates import ntz

STORE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("store_name", T.StringType()),
    T.StructField("sector", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("open_date", T.DateType()),
    T.StructField("close_date", T.DateType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
])

SURVIVAL_ANALYSIS = T.StructType([
    T.StructField("sector", T.StringType(), False),
    T.StructField("avg_duration_days", T.DecimalType(10, 2)),
    T.StructField("sample_size", T.LongType()),
    T.StructField("calculated_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

STORE_OPENING_SNAPSHOT = T.StructType([
    T.StructField("snapshot_date", T.DateType(), False),
    T.StructField("sample_size", T.LongType()),
    T.StructField("latest_opened_at", T.DateType()),
    T.StructField("sectors", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.TimestampNTZType()),
])

SITES = T.StructType([
    T.StructField("site_id", T.LongType(), False),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("radius_m", T.DoubleType()),
    T.StructField("sector", T.StringType()),
])

ADDRESS_COORDS = T.StructType([
    T.StructField("address", T.StringType(), False),
    T.StructField("rank", T.LongType()),
    T.StructField("lng", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])

TABLES = {"store": STORE, "survival_analysis": SURVIVAL_ANALYSIS,
          "store_opening_snapshot": STORE_OPENING_SNAPSHOT, "sites": SITES, "address_coords": ADDRESS_COORDS}


def create_table_sql(name: str, location: str) -> str:
    """``CREATE TABLE IF NOT EXISTS ... USING parquet LOCATION ...``."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[name].fields)
    return f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet LOCATION '{location}'"


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast and order ``df``'s columns to the stored schema ``name``."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])


def snapshot_rows(snapshots: DataFrame, created_at: _dt.datetime) -> DataFrame:
    """Rows for ``store_opening_snapshot`` from ``opening_snapshots`` output."""
    return conform(snapshots.withColumn("created_at", ntz(created_at)),
                   "store_opening_snapshot")


def append_snapshots(spark: SparkSession, snapshots: DataFrame, path: str, created_at: _dt.datetime) -> None:
    """X16 sink: append dated snapshots (daily/weekly job) to the table."""
    snapshot_rows(snapshots, created_at).write.mode("append").parquet(path)
