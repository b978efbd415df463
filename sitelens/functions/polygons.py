"""GeoJSON Polygon and MultiPolygon text as rings of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<array<double>>"


def polygon_rings(text: Column) -> Column:
    """``array<array<array<double>>>``: every ring (outer rings and holes of all parts) as [lng, lat, ...]
    points; NULL for other types or bad JSON."""
    kind = F.from_json(text, "type string")["type"]
    one = F.from_json(text, f"coordinates array<{RING}>")["coordinates"]
    many = F.from_json(text, f"coordinates array<array<{RING}>>")["coordinates"]
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", F.flatten(many))


def vertices(rings: Column) -> Column:
    """The same rings as ``array<array<struct<lat, lng>>>``."""
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(
        F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lng"))))


def short_way(dlng: Column) -> Column:
    """A difference of longitudes taken the shorter way round, in [-180, 180)."""
    return F.pmod(dlng + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)
