"""Area and district tables derived from the driver's tables, as GeoJSON text.

Coordinates are whole multiples of 1e-5 degree, so the text and the SQL of the
oracle (integers divided by 1e5) name the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.sources.tables import read_table

# Fixed values: (part, ring, points) in tenths of a nation's size, around its centre.
OUTER = [(10, 0), (6, 3), (7, 7), (2, 6), (0, 10), (-3, 6), (-7, 8), (-6, 2), (-10, 0), (-5, -4), (-7, -7), (0, -5), (5, -9), (6, -3)]
HOLE = [(2, 0), (0, 2), (-2, 1), (-1, -2)]
ISLAND = [(12, 6), (17, 9), (13, 14)]
LNG0, LAT0 = 12_690_000, 3_748_000


def _text(v: Column) -> Column:
    """A positive whole number of 1e-5 degrees as decimal text."""
    return F.concat((v / F.lit(100_000)).cast("long").cast("string"), F.lit("."), F.lpad((v % 100_000).cast("string"), 5, "0"))


def _ring(points: list[tuple[Column, Column]]) -> Column:
    shown = [F.concat(F.lit("["), _text(x), F.lit(","), _text(y), F.lit("]")) for x, y in [*points, points[0]]]
    return F.concat(F.lit("["), F.concat_ws(",", *shown), F.lit("]"))


def nation_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One star-shaped polygon with a hole for each nation; odd nations have an island as second part."""
    k = F.col("n_nationkey").cast("long")
    x0, y0 = F.lit(LNG0 + 2000) + (k % 5) * 3600, F.lit(LAT0 + 1500) + F.floor(k / 5) * 2200
    size = F.lit(90) + k * 8

    def ring(points):
        return _ring([(x0 + size * dx, y0 + size * dy) for dx, dy in points])

    one = F.concat(F.lit("["), ring(OUTER), F.lit(","), ring(HOLE), F.lit("]"))
    text = F.when(k % 2 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":'), one, F.lit("}"))).otherwise(
        F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), one, F.lit(",["), ring(ISLAND), F.lit("]]}")))
    return read_table(spark, sf_dir, "nation", ["n_nationkey"]).select(k.alias("area_id"), text.alias("geojson"))


def _template(points: list[tuple[int, int]], ring: str, odd_only: bool) -> list[str]:
    return [f"('{ring}', {str(odd_only).upper()}, {ax}, {ay}, {bx}, {by})"
            for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1])]


NATION_EDGES_SQL = f"""
nation_edges AS (
  SELECT CAST(n_nationkey AS BIGINT) AS area_id,
         ({LNG0 + 2000} + (n_nationkey % 5) * 3600 + (90 + n_nationkey * 8) * ax) / 1e5 AS alng,
         ({LAT0 + 1500} + (n_nationkey // 5) * 2200 + (90 + n_nationkey * 8) * ay) / 1e5 AS alat,
         ({LNG0 + 2000} + (n_nationkey % 5) * 3600 + (90 + n_nationkey * 8) * bx) / 1e5 AS blng,
         ({LAT0 + 1500} + (n_nationkey // 5) * 2200 + (90 + n_nationkey * 8) * by_) / 1e5 AS blat
  FROM nation, (VALUES {", ".join(_template(OUTER, "outer", False) + _template(HOLE, "hole", False) + _template(ISLAND, "island", True))})
       t(ring, odd_only, ax, ay, bx, by_)
  WHERE NOT odd_only OR n_nationkey % 2 = 1)"""


def in_polygon_sql(edges: str, keys: str) -> str:
    """Store rows inside the polygons of ``edges`` (its columns ``keys`` name a polygon), by the even-odd rule."""
    return f"""
SELECT {keys}, id, sector, open_date, close_date FROM (
  SELECT {keys}, st.id, st.sector, st.open_date, st.close_date,
         least(alat, blat) AS ya, greatest(alat, blat) AS yb,
         CASE WHEN alat <= blat THEN alng ELSE blng END AS xa, CASE WHEN alat <= blat THEN blng ELSE alng END AS xb, st.lat, st.lng
  FROM {edges} e JOIN store st ON least(e.alat, e.blat) <= st.lat AND greatest(e.alat, e.blat) > st.lat) x
WHERE lng < (xb - xa) * (lat - ya) / (yb - ya) + xa
GROUP BY {keys}, id, sector, open_date, close_date
HAVING count(*) % 2 = 1"""


def region_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One circle for each region."""
    k = F.col("r_regionkey").cast("long")
    return read_table(spark, sf_dir, "region", ["r_regionkey"]).select(
        (k + 1000).alias("area_id"), ((F.lit(LAT0 + 2000) + k * 2000) / F.lit(1e5)).alias("lat"),
        ((F.lit(LNG0 + 3000) + k * 3000) / F.lit(1e5)).alias("lng"), (F.lit(600.0) + k * 700.0).cast("double").alias("radius_m"))


REGION_CIRCLES_SQL = f"""
region_circles AS (
  SELECT CAST(r_regionkey + 1000 AS BIGINT) AS area_id, ({LAT0 + 2000} + r_regionkey * 2000) / 1e5 AS lat,
         ({LNG0 + 3000} + r_regionkey * 3000) / 1e5 AS lng, 6e2 + r_regionkey * 7e2 AS radius_m
  FROM region)"""


def mixed_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of nations and circles of regions in one table."""
    return nation_areas(spark, sf_dir).unionByName(region_circles(spark, sf_dir), allowMissingColumns=True)


DISTRICT_LEVELS = ["si", "gu", "dong"]


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nested levels: a slanted strip for each region (si), a slice of it for each of its nations (gu), a
    block in the slice for each supplier of the nation (dong)."""
    r = read_table(spark, sf_dir, "region", ["r_regionkey"]).select(F.col("r_regionkey").cast("long").alias("r"))
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"]).select(
        F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"),
        (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("long").alias("j"))
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"]).select(
        F.col("s_suppkey").cast("long").alias("s"), F.col("s_nationkey").cast("long").alias("n"),
        (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).cast("long").alias("i")).join(n, "n")

    def area(df: DataFrame, level: str, key: str, x: Column, y: Column, wide: int, high: int, slant: int) -> DataFrame:
        ring = _ring([(x, y), (x + wide, y), (x + wide + slant, y + high), (x + slant, y + high)])
        return df.select(F.lit(level).alias("level"), F.col(key).alias("area_id"),
                         F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}")).alias("geojson"))

    strip, slice_x, slice_y = F.lit(LNG0) + F.col("r") * 4000, F.lit(LNG0) + F.col("r") * 4000 + F.col("j") * 300, F.lit(LAT0) + F.col("j") * 2400
    return area(r, "si", "r", strip, F.lit(LAT0).cast("long"), 4000, 12_000, 1500) \
        .unionByName(area(n, "gu", "n", slice_x, slice_y, 4000, 2400, 300)) \
        .unionByName(area(s, "dong", "s", slice_x + (F.col("i") % 8) * 500, slice_y + (F.floor(F.col("i") / 8) % 5) * 480, 500, 480, 0))


def _district_sql(level: str, source: str, key: str, x: str, y: str, wide: int, high: int, slant: int) -> str:
    corner = [(x, y), (f"{x} + {wide}", y), (f"{x} + {wide + slant}", f"{y} + {high}"), (f"{x} + {slant}", f"{y} + {high}")]
    return " UNION ALL ".join(
        f"SELECT '{level}' AS level, {key} AS area_id, ({ax}) / 1e5 AS alng, ({ay}) / 1e5 AS alat, ({bx}) / 1e5 AS blng, ({by}) / 1e5 AS blat FROM {source}"
        for (ax, ay), (bx, by) in zip(corner, corner[1:] + corner[:1]))


_SLICE_X, _SLICE_Y = f"{LNG0} + r * 4000 + j * 300", f"{LAT0} + j * 2400"
DISTRICTS_SQL = f"""
gu AS (SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS r,
              row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS j FROM nation),
si AS (SELECT CAST(r_regionkey AS BIGINT) AS r FROM region),
dong AS (SELECT s_suppkey AS s, gu.*, i FROM (
           SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CAST(s_nationkey AS BIGINT) AS n,
                  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier) t JOIN gu USING (n)),
district_edges AS (
  {_district_sql("si", "si", "r", f"{LNG0} + r * 4000", str(LAT0), 4000, 12_000, 1500)} UNION ALL
  {_district_sql("gu", "gu", "n", _SLICE_X, _SLICE_Y, 4000, 2400, 300)} UNION ALL
  {_district_sql("dong", "dong", "s", f"{_SLICE_X} + (i % 8) * 500", f"{_SLICE_Y} + ((i // 8) % 5) * 480", 500, 480, 0)})"""
