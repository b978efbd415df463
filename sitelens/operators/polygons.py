"""Areas of any shape: polygons with holes, multi-polygons and circles.

An area table holds ``area_id`` and either ``geojson`` (Polygon or
MultiPolygon) or a circle (``lat, lng, radius_m``).  One cell index covers all
shapes, and one equi-join on cells finds the stores inside:

* Rings are cut into edges; an edge goes the shorter way round the Earth, so
  longitudes run on across 180 degrees (``... 179, 181 ...``).  All rings of an
  area count together under the even-odd rule: a hole is a ring like others.
* Each area picks a cell size (360 / 2^level degrees) from its own extent, so
  that its bounding box has about 8 cells an edge.  An edge belongs to the cells it
  crosses.  A cell without edges lies wholly inside or wholly outside: stores
  in it need no test, and cells outside are left out.
* A cell with edges knows whether its south-west corner is inside (edges that
  a ray eastward along its south side meets) and carries only the edges
  that cross it.  A store is inside if the path from that corner - north
  along the west side, then east - crosses an even number of them and the
  corner is inside, or an odd number and it is outside.
* A circle covers the cells of its bounding box; the ellipsoid distance decides.

The index is broadcast while its counted rows and bytes are few, else joined by
the salted shuffle join.  A store in several areas counts in each of them.

Areas that cannot be used are returned by ``rejected_areas`` with reasons, and
left out everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.functions.numeric import round_half_up
from sitelens.functions.polygons import polygon_rings, short_way, vertices
from sitelens.operators.circles import located
from sitelens.operators.distance_join import salted_join, with_distances
from sitelens.operators.first_area import MAX_ROWS, cell_number, first_areas
from sitelens.session import ensure_checkpoint_dir

AREA_COLS = ["area_id", "geojson", "lat", "lng", "radius_m"]
#: Cells of a bounding box: about CELLS_PER_EDGE for each edge, within these bounds.
CELLS_PER_EDGE, MIN_CELLS, MAX_CELLS = 8, 64, 65_536
MAX_LEVEL = 24
#: Cell borders lie off the round coordinates that areas are drawn with.
OFFSET = 0.0000314159265
MAX_RADIUS_M = 2_000_000.0
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 2_000_000, 256_000_000
HOT_ROWS, HOT_PAIRS = 1_000_000, 100_000_000
KEY = ["level", "cx", "cy"]


def area_table(areas: DataFrame) -> DataFrame:
    """The columns of ``AREA_COLS``; those that ``areas`` lacks are null."""
    kinds = {"geojson": "string", "lat": "double", "lng": "double", "radius_m": "double"}
    return areas.select(*[F.col(c) if c in areas.columns else F.lit(None).cast(kinds[c]).alias(c) for c in AREA_COLS])


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that come out of a generator, so that no later filter or projection evaluates them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def checked_areas(areas: DataFrame) -> DataFrame:
    """``area_id, rings, lat, lng, radius_m, reasons``; usable areas have no reasons."""
    a = _once(area_table(areas), rings=vertices(polygon_rings(F.col("geojson")))) \
        .withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("area_id")))
    points = F.flatten("rings")
    bad_point = F.exists(points, lambda p: p["lat"].isNull() | p["lng"].isNull() | (F.abs(p["lat"]) > 90.0) | (F.abs(p["lng"]) > 540.0)
                         | F.isnan(p["lat"]) | F.isnan(p["lng"]))
    few = F.exists("rings", lambda r: F.size(F.array_distinct(r)) < 3)
    turns = F.exists("rings", lambda r: F.abs(F.aggregate(
        F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), lambda p, q: short_way(q["lng"] - p["lng"])),
        F.lit(0.0), lambda s, d: s + d)) > 180.0)
    shape, circle = F.col("geojson").isNotNull(), F.col("radius_m").isNotNull()
    centre_ok = F.col("lat").between(-90.0, 90.0) & F.col("lng").between(-180.0, 180.0)
    radius_ok = (F.col("radius_m") > 0) & (F.col("radius_m") <= MAX_RADIUS_M)

    def say(wrong: Column, reason: str) -> Column:
        return F.when(F.coalesce(wrong, F.lit(False)), F.lit(reason))

    reasons = F.array_compact(F.array(
        say(F.col("area_id").isNull(), "NO_ID"),
        say(F.col("copies") > 1, "REPEATED_ID"),
        say(~shape & ~circle, "NO_SHAPE"), say(shape & circle, "TWO_SHAPES"),
        say(shape & (F.col("rings").isNull() | (F.size("rings") == 0) | F.exists("rings", lambda r: r.isNull())), "BAD_SHAPE"),
        say(shape & bad_point, "BAD_COORDINATE"), say(shape & few, "FEW_POINTS"), say(shape & turns, "ROUND_A_POLE"),
        say(circle & ~F.coalesce(centre_ok, F.lit(False)), "BAD_CENTRE"), say(circle & ~radius_ok, "BAD_RADIUS")))
    return _once(a, reasons=reasons).drop("copies")


def rejected_areas(areas: DataFrame) -> DataFrame:
    """``area_id, reasons`` of the areas that no operator here uses."""
    return checked_areas(areas).filter(F.size("reasons") > 0).select("area_id", "reasons")


def edges(usable: DataFrame) -> DataFrame:
    """``area_id, alat, alng, blat, blng``: the edges of all rings, south end first, longitudes running on."""
    # Dealt by area once: the windows over a ring and over an area need no other shuffle.
    ring = usable.repartition("area_id").select("area_id", F.posexplode("rings").alias("ring", "points"))
    point = ring.select("area_id", "ring", F.posexplode("points").alias("no", "p"), F.element_at("points", 1).alias("p0")) \
        .select("area_id", "ring", "no", "p.lat", "p.lng", F.col("p0.lng").alias("lng0"), F.col("p0.lat").alias("lat0"))
    along = Window.partitionBy("area_id", "ring").orderBy("no")
    step = F.coalesce(short_way(F.col("lng") - F.lag("lng").over(along)), F.lit(0.0))
    # Rings that never pass 180 degrees keep their longitudes as they were written, to the last bit.
    run = point.withColumn("plain", F.abs(F.col("lng") - F.coalesce(F.lag("lng").over(along), F.col("lng"))) < 180.0) \
        .withColumn("step", step)
    run = run.withColumn("run", F.col("lng0") + F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("jumps", F.sum(F.when(F.col("plain"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("x", F.when(F.col("jumps") == 0, F.col("lng")).otherwise(F.col("run")))
    end = run.withColumn("nlat", F.coalesce(F.lead("lat").over(along), F.col("lat0"))) \
        .withColumn("nx", F.coalesce(F.lead("x").over(along), F.col("lng0")))
    up = F.col("lat") <= F.col("nlat")
    return end.filter((F.col("lat") != F.col("nlat")) | (F.col("x") != F.col("nx"))).select(
        "area_id",
        F.when(up, F.col("lat")).otherwise(F.col("nlat")).alias("alat"), F.when(up, F.col("x")).otherwise(F.col("nx")).alias("alng"),
        F.when(up, F.col("nlat")).otherwise(F.col("lat")).alias("blat"), F.when(up, F.col("nx")).otherwise(F.col("x")).alias("blng"))


def _size(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _row(lat: Column, g: Column) -> Column:
    return F.floor((lat + F.lit(90.0 + OFFSET)) / g).cast("long")


def _column(lng: Column, g: Column) -> Column:
    """Column of a running longitude; ``pmod(_, 2^level)`` names the cell."""
    return F.floor((lng + F.lit(180.0 + OFFSET)) / g).cast("long")


def _south(cy: Column, g: Column) -> Column:
    return cy * g - F.lit(90.0 + OFFSET)


def _west(col: Column, g: Column) -> Column:
    return col * g - F.lit(180.0 + OFFSET)


def _level(high: Column, wide: Column, wanted: Column) -> Column:
    """Finest level at which a box has at most about ``wanted`` cells (every second one, so that few levels are in use)."""
    high, wide = F.greatest(high, F.lit(1e-6)), F.greatest(wide, F.lit(1e-6))
    # (high / g + 1) * (wide / g + 1) <= wanted, solved for 1 / g.
    b = high + wide
    inverse = (F.sqrt(b * b + F.lit(4.0) * high * wide * (wanted - 1.0)) - b) / (F.lit(2.0) * high * wide)
    fine = F.floor(F.log2(F.lit(360.0) * inverse))
    return F.least(F.greatest(F.floor(fine / 2) * 2, F.lit(0)), F.lit(MAX_LEVEL)).cast("int")


def _x_at(lat: Column) -> Column:
    """Longitude of the edge of the row at ``lat``."""
    return (F.col("blng") - F.col("alng")) * (lat - F.col("alat")) / (F.col("blat") - F.col("alat")) + F.col("alng")


def polygon_cells(usable: DataFrame) -> DataFrame:
    """``area_id, level, cx, cy, west, south, corner, edges``: the cells of polygons that are not wholly outside."""
    whole = Window.partitionBy("area_id")
    e = edges(usable).select(
        "*", F.count(F.lit(1)).over(whole).alias("n"), F.min("alat").over(whole).alias("lat0"), F.max("blat").over(whole).alias("lat1"),
        F.min(F.least("alng", "blng")).over(whole).alias("lng0"), F.max(F.greatest("alng", "blng")).over(whole).alias("lng1"))
    wanted = F.greatest(F.least(F.col("n") * float(CELLS_PER_EDGE), F.lit(float(MAX_CELLS))), F.lit(float(MIN_CELLS)))
    e = e.withColumn("level", _level(F.col("lat1") - F.col("lat0"), F.col("lng1") - F.col("lng0"), wanted))
    ensure_checkpoint_dir(usable.sparkSession)
    e = e.checkpoint()  # used three times below
    box = e.groupBy("area_id").agg(*[F.first(c).alias(c) for c in ("level", "lat0", "lat1", "lng0", "lng1")])
    g = _size(F.col("level"))

    # An edge meets one run of columns in every row it passes.
    first, last = _row(F.col("alat"), g), _row(F.col("blat"), g)
    passed = e.select("area_id", "level", "alat", "alng", "blat", "blng").withColumn("cy", F.explode(F.sequence(first, last)))
    low = F.greatest("alat", _south(F.col("cy"), g))
    high = F.least("blat", _south(F.col("cy") + 1, g))
    flat = F.col("alat") == F.col("blat")
    x0 = F.when(flat, F.col("alng")).otherwise(_x_at(low))
    x1 = F.when(flat, F.col("blng")).otherwise(_x_at(high))
    # One cell more where rounding could put the end on the other side of a border.
    slack = g * F.lit(1e-9)
    crossed = passed.withColumn("col", F.explode(F.sequence(_column(F.least(x0, x1) - slack, g), _column(F.greatest(x0, x1) + slack, g))))
    edge = F.struct("alat", "alng", "blat", "blng")
    held = crossed.groupBy("area_id", "cy", "col").agg(F.collect_list(edge).alias("edges"))

    # Where the edges pass the south side of a row.
    line = _south(F.col("cy"), g)
    passes = (F.col("alat") > line) != (F.col("blat") > line)
    sides = passed.filter(passes).groupBy("area_id", "cy").agg(F.collect_list(_x_at(line)).alias("passes"))

    rows = box.withColumn("cy", F.explode(F.sequence(_row(F.col("lat0"), g), _row(F.col("lat1"), g))))
    cells = rows.withColumn("col", F.explode(F.sequence(_column(F.col("lng0"), g), _column(F.col("lng1"), g)))) \
        .select("area_id", "level", "cy", "col")
    west = _west(F.col("col"), g)
    full = cells.join(sides, ["area_id", "cy"], "left").join(held, ["area_id", "cy", "col"], "left") \
        .withColumn("west", west).withColumn("south", _south(F.col("cy"), g))
    corner = F.coalesce(F.size(F.filter("passes", lambda x: x > F.col("west"))) % 2 == 1, F.lit(False))
    return full.withColumn("corner", F.when(F.col("passes").isNull(), F.lit(False)).otherwise(corner)) \
        .filter(F.col("corner") | F.col("edges").isNotNull()) \
        .select("area_id", "level", F.pmod("col", F.pow(F.lit(2.0), "level").cast("long")).alias("cx"), "cy",
                "west", "south", "corner", "edges")


def circle_cells(usable: DataFrame) -> DataFrame:
    """``area_id, level, cx, cy, site_lat, site_lng, radius_m``: the cells of the bounding boxes of circles."""
    lat, lng, r = F.col("lat"), F.col("lng"), F.col("radius_m")
    high, wide = geo.lat_reach_deg(r), geo.lng_reach_deg(lat, r)
    level = _level(high * 2.0, F.least(wide * 2.0, F.lit(360.0)), F.lit(float(MIN_CELLS)))
    c = usable.withColumn("level", level).withColumn("high", high).withColumn("wide", wide)
    g, columns = _size(F.col("level")), F.pow(F.lit(2.0), F.col("level")).cast("long")
    first, last = _column(lng - F.col("wide"), g), _column(lng + F.col("wide"), g)
    run = F.when(F.col("wide") >= 180.0, F.sequence(F.lit(0).cast("long"), columns - 1)) \
        .otherwise(F.sequence(first, F.least(last, first + columns - 1)))
    return c.withColumn("cy", F.explode(F.sequence(_row(F.greatest(lat - F.col("high"), F.lit(-90.0)), g),
                                                   _row(F.least(lat + F.col("high"), F.lit(90.0)), g)))) \
        .withColumn("cx", F.explode(F.array_distinct(F.transform(run, lambda x: F.pmod(x, columns))))) \
        .select("area_id", "level", "cx", "cy", lat.alias("site_lat"), lng.alias("site_lng"), "radius_m")


def area_cells(areas: DataFrame) -> DataFrame:
    """The cell index of all usable areas, one row a cell of an area."""
    usable = checked_areas(areas).filter(F.size("reasons") == 0)
    shapes = polygon_cells(usable.filter(F.col("rings").isNotNull()).select("area_id", "rings"))
    circles = circle_cells(usable.filter(F.col("radius_m").isNotNull()))
    return shapes.unionByName(circles, allowMissingColumns=True)


def _inside_polygon() -> Column:
    """Whether the store of a candidate row is inside the polygon of its cell."""
    g = _size(F.col("level"))
    west, south, lat = F.col("west"), F.col("south"), F.col("lat")
    x = F.col("lng") + F.lit(360.0) * F.round((west + g * 0.5 - F.col("lng")) / 360.0)

    def crossings(e: Column) -> Column:
        # North along the west side, from the corner to the height of the store ...
        y_at = (e["blat"] - e["alat"]) * (west - e["alng"]) / (e["blng"] - e["alng"]) + e["alat"]
        spans = (e["alng"] > west) != (e["blng"] > west)
        north = F.when(spans & ((y_at > south) != (y_at > lat)), 1).otherwise(0)
        # ... then east to the store.
        x_at = (e["blng"] - e["alng"]) * (lat - e["alat"]) / (e["blat"] - e["alat"]) + e["alng"]
        straddles = (e["alat"] > lat) != (e["blat"] > lat)
        east = F.when(straddles & (x_at > west) & (x_at <= x), 1).otherwise(0)
        return north + east

    crossed = F.aggregate(F.coalesce("edges", F.array()), F.lit(0), lambda n, e: n + crossings(e))
    return (crossed % 2 == 1) != F.col("corner")


def stores_in_areas(areas: DataFrame, stores: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``area_id`` and the store columns, one row for every store inside an area (``stores`` has id, lat, lng)."""
    ensure_checkpoint_dir(areas.sparkSession)
    # Made once: it is counted, then joined.
    index = area_cells(areas).withColumn("row_bytes", F.lit(80) + F.coalesce(F.size("edges"), F.lit(0)) * 48).checkpoint()
    size = index.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("row_bytes").alias("bytes")).collect()  # one row a level
    index = index.drop("row_bytes")
    levels = sorted(r["level"] for r in size)
    located = stores.filter(F.col("lat").between(-90.0, 90.0) & F.col("lng").between(-180.0, 180.0))
    cell = [F.struct(F.lit(k).alias("level"), F.pmod(_column(F.col("lng"), F.lit(360.0 / 2 ** k)), F.lit(2 ** k)).alias("cx"),
                     _row(F.col("lat"), F.lit(360.0 / 2 ** k)).alias("cy")) for k in levels or [0]]
    # Only the levels in use; the names of the index cannot clash with those of the stores.
    keyed = located.select(F.struct(*stores.columns).alias("store"), F.col("id"), F.col("lat"), F.col("lng"),
                           F.inline(F.array(*cell)))
    if sum(r["n"] for r in size) <= max_broadcast_rows and sum(r["bytes"] or 0 for r in size) <= MAX_BROADCAST_BYTES:
        pairs = keyed.join(F.broadcast(index), KEY)
    else:
        pairs = salted_join(index, keyed, HOT_ROWS, KEY, HOT_PAIRS, site_hash="area_id")
    near = with_distances(pairs, distance_m="spheroid")
    inside = F.when(F.col("radius_m").isNotNull(), F.col("distance_m") <= F.col("radius_m")).otherwise(_inside_polygon())
    return near.filter(inside).select("area_id", "store.*")


def area_sector_counts(areas: DataFrame, stores: DataFrame, **kwargs) -> DataFrame:
    """``area_id, sector, n`` for areas of any shape."""
    return stores_in_areas(areas, stores.select("id", "sector", "lat", "lng"), **kwargs) \
        .groupBy("area_id", "sector").agg(F.count(F.lit(1)).alias("n"))


def area_sector_share(areas: DataFrame, stores: DataFrame, **kwargs) -> DataFrame:
    """Stores of every sector in every area and their percent of the area's stores."""
    counts = area_sector_counts(areas, stores, **kwargs)
    total = F.sum("n").over(Window.partitionBy("area_id"))
    return counts.select("area_id", "sector", "n", round_half_up(F.col("n") / total * F.lit(100.0)).alias("share_pct"))


def area_statistics(areas: DataFrame, stores: DataFrame, **kwargs) -> DataFrame:
    """Every usable area (also an empty one) with its stores, open stores, sectors, commonest
    sector (ties: first by name) and mean opening date."""
    inside = stores_in_areas(areas, stores.select("id", "sector", "open_date", "close_date", "lat", "lng"), **kwargs)
    # First by area and sector (partial sums), then by area: no area's stores meet in one task.
    part = inside.groupBy("area_id", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("close_date").isNull()).alias("n_open"),
        F.sum(F.unix_date("open_date")).alias("days"), F.count("open_date").alias("dated"))
    named = F.when(F.col("sector").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("sector")))
    stats = part.groupBy("area_id").agg(
        F.sum("n").alias("n_stores"), F.sum("n_open").alias("n_open"), F.count("sector").alias("n_sectors"),
        F.min(named)["sector"].alias("top_sector"),
        F.date_from_unix_date(F.floor(F.sum("days") / F.sum("dated")).cast("int")).alias("mean_open_date"))
    known = checked_areas(areas).filter(F.size("reasons") == 0).select("area_id")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_stores", "n_open", "n_sectors")]
    return known.join(stats, "area_id", "left").select("area_id", *zero, "top_sector", "mean_open_date")


def district_paths(districts: DataFrame, stores: DataFrame, levels: list[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """``id`` and one column for each of ``levels`` (outermost first): the district of that level a store
    lies in, from one pass over the polygons of all levels.

    ``districts`` has ``level`` (a member of ``levels``) and the area columns.  Where districts of a level
    overlap the smallest ``area_id`` counts, however many overlap; a store outside all districts is left out.
    """
    ensure_checkpoint_dir(districts.sparkSession)
    keyed = districts.withColumn("area_id", F.struct(F.col("level"), F.col("area_id")))
    kind = F.lit(-1)  # known to hold stores, without a column of its own
    for i, name in reversed(list(enumerate(levels))):
        kind = F.when((F.col("area_id.level") == name) & F.col("area_id.area_id").isNotNull(), F.lit(i)).otherwise(kind)
    index = area_cells(keyed).withColumn("kind", kind).withColumn("area_id", F.col("area_id.area_id")) \
        .withColumn("cell", cell_number(F.col("level"), F.col("cx"), F.col("cy"))).drop("cx", "cy", "geojson").checkpoint()
    used = sorted(r["level"] for r in index.select("level").distinct().collect())  # one row a level
    cells = [cell_number(F.lit(k), F.pmod(_column(F.col("lng"), F.lit(360.0 / 2 ** k)), F.lit(2 ** k)), _row(F.col("lat"), F.lit(360.0 / 2 ** k)))
             for k in used or [0]]
    placed = located(stores.select("id", "lat", "lng")).filter(F.col("lat").between(-90.0, 90.0) & F.col("lng").between(-180.0, 180.0))
    found = first_areas(index, placed.withColumn("cell", F.explode(F.array(*cells))), max_rows)
    at = [F.min(F.when(F.col("kind") == levels.index(name), F.col("area_id"))).alias(name) for name in levels]
    return found.groupBy("id").agg(*at)


def district_levels(districts: DataFrame, stores: DataFrame, levels: list[str], **kwargs) -> DataFrame:
    """Stores and open stores by district with subtotals at every level (``ROLLUP``), districts by
    containment.  ``level`` is the grouping id: 0 for the innermost rows."""
    paths = district_paths(districts, stores, levels, **kwargs)
    state = stores.select("id", F.col("close_date").isNull().alias("is_open"))
    counted = paths.join(state, "id").groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_open").alias("n_open"))
    return counted.rollup(*levels).agg(F.sum("n").alias("n"), F.sum("n_open").alias("n_open"),
                                       F.grouping_id().cast("long").alias("level"))
