"""Site tables: the points every spatial question is asked about.

A request in the original service asked about one point; here a *table* of
sites is answered in one job.  ``customer_sites`` derives one candidate site
per customer row, so the site table grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.sources.tables import read_table

SITE_SCHEMA = T.StructType([
    T.StructField("site_id", T.LongType(), False),
    T.StructField("lat", T.DoubleType(), True),
    T.StructField("lng", T.DoubleType(), True),
    T.StructField("radius_m", T.DoubleType(), True),
    T.StructField("sector", T.StringType(), True),
])

# Radii cycled over customer sites (metres).
SITE_RADII = [100.0, 500.0, 1000.0, 2000.0]

SITES_SQL = """
sites AS (
  SELECT c_custkey AS site_id,
         3.748e1 + ((c_custkey * 7727) % 11987) / 1e5 AS lat,
         1.269e2 + ((c_custkey * 6007) % 19997) / 1e5 AS lng,
         CAST(CASE c_custkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 500 WHEN 2 THEN 1000 ELSE 2000 END AS DOUBLE) AS radius_m,
         CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS sector
  FROM customer)
"""


def customer_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per customer: a point in the store box, a radius from
    ``SITE_RADII`` and the customer's segment as sector (no sector filter for
    customers with a negative balance)."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    k = F.col("c_custkey")
    radius = F.element_at(F.array(*[F.lit(r) for r in SITE_RADII]), (k % 4 + 1).cast("int"))
    return c.select(
        k.cast("long").alias("site_id"),
        (F.lit(37.48) + ((k * 7727) % 11987) / F.lit(1e5)).alias("lat"),
        (F.lit(126.9) + ((k * 6007) % 19997) / F.lit(1e5)).alias("lng"),
        radius.cast("double").alias("radius_m"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("sector"),
    )


# The manual test places (site_id, lat, lng); site 9 is at sea.
LANDMARKS = [
    (1, 37.5636, 126.9826),
    (2, 37.4980, 127.0276),
    (3, 37.5563, 126.9236),
    (4, 37.5345, 126.9949),
    (5, 37.5704, 126.9918),
    (6, 37.5133, 127.1028),
    (7, 37.5551, 126.9368),
    (8, 37.5407, 127.0692),
    (9, 37.0, 126.0),
]


def landmark_sites(spark: SparkSession, radius_m: float = 500.0, sector: str | None = None) -> DataFrame:
    rows = [(i, lat, lng, float(radius_m), sector) for i, lat, lng in LANDMARKS]
    return spark.createDataFrame(rows, SITE_SCHEMA)


def landmark_sql(radius_m: float = 500.0) -> str:
    vals = ", ".join(f"({i}, {lat!r}, {lng!r})" for i, lat, lng in LANDMARKS)
    return (f"sites AS (SELECT CAST(i AS BIGINT) AS site_id, CAST(a AS DOUBLE) AS lat, CAST(b AS DOUBLE) AS lng, "
            f"CAST({radius_m!r} AS DOUBLE) AS radius_m, CAST(NULL AS VARCHAR) AS sector "
            f"FROM (VALUES {vals}) t(i, a, b))")


def grid_sites(stores: DataFrame, step_deg: float = 0.01, radius_m: float = 500.0,
               sector: str | None = None) -> DataFrame:
    """A regular grid of sites over the located stores' bounding box (one
    site per ``step_deg`` x ``step_deg`` node), for score heat maps.  The box
    comes from one aggregate; the nodes are generated by two explodes, the
    second in parallel."""
    inv = round(1.0 / step_deg)
    b = stores.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).agg(
        F.floor(F.min("lat") * F.lit(float(inv))).alias("i0"), F.floor(F.max("lat") * F.lit(float(inv))).alias("i1"),
        F.floor(F.min("lng") * F.lit(float(inv))).alias("j0"), F.floor(F.max("lng") * F.lit(float(inv))).alias("j1"))
    # Grid rows are dealt out before their nodes are made: no task makes the whole grid.
    tasks = max(int(stores.sparkSession.conf.get("spark.sql.shuffle.partitions")), stores.sparkSession.sparkContext.defaultParallelism)
    g = b.select(F.explode(F.sequence("i0", "i1")).alias("i"), "j0", "j1").repartition(tasks, "i") \
         .select("i", F.explode(F.sequence("j0", "j1")).alias("j"))
    return g.select((F.col("i") * F.lit(1_000_000) + F.col("j")).cast("long").alias("site_id"),
                    (F.col("i") / F.lit(float(inv))).alias("lat"), (F.col("j") / F.lit(float(inv))).alias("lng"),
                    F.lit(float(radius_m)).alias("radius_m"), F.lit(sector).cast("string").alias("sector"))
