"""The ``store`` table, derived from the driver's TPC-H-style tables.

The mapping (one store per order; customer name / segment / nation name as
name / sector / address; order date as opening; last ship date of a
finished order as closing; a deterministic scatter of 95 % of the orders over
a 17 km x 13 km box as coordinates) is the same text as ``STORE_SQL`` so
DuckDB can rebuild it for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.sources.tables import read_table

# Fixed values of the store mapping (must equal STORE_SQL below).
LNG0, LNG_MUL, LNG_MOD = 126.9, 7919, 19997
LAT0, LAT_MUL, LAT_MOD = 37.48, 104729, 11987
UNLOCATED_EVERY = 20

STORE_COLUMNS = ["id", "store_name", "sector", "address", "open_date", "close_date", "lat", "lng"]

STORE_SQL = """
ls AS (SELECT l_orderkey, MAX(l_shipdate) AS m FROM lineitem GROUP BY l_orderkey),
store AS (
  SELECT o.o_orderkey AS id, c.c_name AS store_name, c.c_mktsegment AS sector, n.n_name AS address,
         CAST(o.o_orderdate AS DATE) AS open_date,
         CASE WHEN o.o_orderstatus = 'F' THEN CAST(ls.m AS DATE) END AS close_date,
         CASE WHEN o.o_orderkey % 20 <> 0 THEN 3.748e1 + ((o.o_orderkey * 104729) % 11987) / 1e5 END AS lat,
         CASE WHEN o.o_orderkey % 20 <> 0 THEN 1.269e2 + ((o.o_orderkey * 7919) % 19997) / 1e5 END AS lng
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN ls ON ls.l_orderkey = o.o_orderkey)
"""


def _scatter(key, base: float, mul: int, mod: int):
    return F.when(key % UNLOCATED_EVERY != 0,
                  F.lit(base) + ((key * mul) % mod) / F.lit(1e5))


def store_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, store_name, sector, address, open_date, close_date, lat, lng``."""
    orders = read_table(spark, sf_dir, "orders",
                        ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    customer = read_table(spark, sf_dir, "customer",
                          ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])
    # Dimension joins are left to the planner: it broadcasts a side only when
    # its measured size is under spark.sql.autoBroadcastJoinThreshold (AQE
    # re-checks with runtime sizes), else it shuffles both sides.
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    # Last ship date per order: partial aggregate map-side, one shuffle on
    # l_orderkey, which is also the join key below.
    last_ship = (read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_shipdate"])
                 .groupBy("l_orderkey").agg(F.max("l_shipdate").alias("m")))
    key = F.col("o_orderkey")
    return (orders
            .join(last_ship, orders.o_orderkey == last_ship.l_orderkey, "left")
            .join(customer, orders.o_custkey == customer.c_custkey, "left")
            .join(nation, F.col("c_nationkey") == nation.n_nationkey, "left")
            .select(key.alias("id"),
                    F.col("c_name").alias("store_name"),
                    F.col("c_mktsegment").alias("sector"),
                    F.col("n_name").alias("address"),
                    F.col("o_orderdate").cast("date").alias("open_date"),
                    F.when(F.col("o_orderstatus") == "F", F.col("m").cast("date")).alias("close_date"),
                    _scatter(key, LAT0, LAT_MUL, LAT_MOD).alias("lat"),
                    _scatter(key, LNG0, LNG_MUL, LNG_MOD).alias("lng")))


def write_store_table(stores: DataFrame, path: str, n_files: int | None = None, grid_deg: float = 0.01) -> None:
    """Materialise the store table once (the production shape of this view).

    Rows are range-partitioned and sorted by ``(sector, cy, cx)`` so parquet
    min/max statistics let sector and bounding-box filters skip row groups,
    and one hot sector is split over many files by its cells (a range on
    the composite key, not a hash on the sector alone).
    """
    from sitelens.functions import geo
    spark = stores.sparkSession
    n = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = stores.withColumn("cy", geo.cell_y(F.col("lat"), grid_deg)).withColumn("cx", geo.cell_x(F.col("lng"), grid_deg))
    (t.repartitionByRange(n, "sector", "cy", "cx").sortWithinPartitions("sector", "cy", "cx")
      .write.mode("overwrite").parquet(path))


def read_store_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*STORE_COLUMNS)
