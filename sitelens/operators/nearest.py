"""Nearest N stores of every site (X3), exact, by an adaptive quadtree of counts.

Every second level of a quadtree (cells of 360 / 2^level degrees, 360 degrees
down to 38 m) counts the stores of each sector and of all sectors, from partial
sums.  The tree gives every site a radius that surely holds its N nearest:

1. Of the cells around the site at the deepest level whose own cell holds N
   stores, and one step below, the nearest ones that hold N together: their
   farthest corner is the radius.  Where stores are about evenly dense the
   circle then holds a small multiple of N, however dense they are.
2. Sites whose circle may still hold more than ``CROWDED`` x N stores (an empty
   place beside a crowded one, or a site far from all stores) go on best first:
   their cells are split, cells beyond the radius dropped, and the radius drawn in
   to the nearest cells that hold N, until few stores are left or the cells are
   smallest.  Each round is one equi-join of the cells still open.

Only the stores of the cells left at the end are joined with the site (a circle
drawn from far away would touch cells that hold them all); a ranking per site
then gives the result.  Distances use the ellipsoid up to 100 km and the great
circle beyond; no store is out of reach.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.functions.numeric import round_half_up
from sitelens.functions.polygons import short_way
from sitelens.operators.distance_join import ANY_SECTOR, DEFAULT_PLAN, prepare_sites, salted_join, with_distances
from sitelens.session import ensure_checkpoint_dir
from sitelens.sources.tables import has_at_most

STEP, DEEPEST = 2, 20
LEVELS = range(0, DEEPEST + 1, STEP)
#: A site with more than CROWDED x N stores in the cells its circle touches is refined.
CROWDED = 64
# Head-room of the bounds against rounding.
SLACK, SLACK_M = 1e-9, 1e-3
KEY = ["sk", "level", "cx", "cy"]


def _side(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def count_tree(stores: DataFrame, match_sector: bool = True) -> DataFrame:
    """``sk, level, cx, cy, n``: stores in every cell that holds some, by sector and over all."""
    sector = F.array(F.col("sector"), F.lit(ANY_SECTOR)) if match_sector else F.array(F.lit(ANY_SECTOR))
    located = stores.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    smallest = 360.0 / 2 ** DEEPEST
    # Stores of one smallest cell are one row before the levels multiply them.
    cells = located.select(F.explode(sector).alias("sk"), geo.cell_x(F.col("lng"), smallest).alias("x"),
                           geo.cell_y(F.col("lat"), smallest).alias("y")) \
        .groupBy("sk", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return cells.select("sk", "n", F.inline(_up(F.col("x"), F.col("y"), list(LEVELS)))).groupBy(*KEY).agg(F.sum("n").alias("n"))


def _up(x: Column, y: Column, levels: list[int]) -> Column:
    """The cells of the levels that hold a smallest cell."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(x, DEEPEST - k).alias("cx"), F.shiftright(y, DEEPEST - k).alias("cy"))
                     for k in levels])


def _with_spans(cells: DataFrame) -> DataFrame:
    """Cells with ``far`` and ``near``: no point of the cell is farther from the site, none is nearer (metres, global metric).

    Both close in on the distance as cells get smaller.  Up to ``NEAR_M`` the
    metric is sqrt((m dphi)^2 + (n cos(phm) dlambda)^2) with radii of curvature
    at the mean latitude phm: each factor is taken at the end of its range over
    the cell.  Beyond, it is the great circle: that to the middle of the cell,
    half a diagonal more or less.  Steps are columns, each computed once; the
    results come out of a generator, so that no filter evaluates them again.
    """
    def nearest_zero(low: Column, high: Column) -> Column:
        return F.when((low <= 0) & (high >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(high)))

    lat, g = F.col("site_lat"), F.col("_g")
    south, north, middle = F.col("_south"), F.col("_north"), F.col("_middle")
    steep, flat, cs, cf = F.col("_steep"), F.col("_flat"), F.col("_cs"), F.col("_cf")
    meridian = geo.WGS84_A * (1.0 - geo.WGS84_E2)
    far_y = F.radians(F.greatest(lat - south, north - lat)) * meridian / (cs * cs * cs)
    far_x = F.radians(F.least(middle + g * 0.5, F.lit(180.0))) * geo.WGS84_A / cs * F.cos(flat)
    near_y = F.radians(F.greatest(south - lat, lat - north, F.lit(0.0))) * meridian / (cf * cf * cf)
    near_x = F.radians(F.greatest(middle - g * 0.5, F.lit(0.0))) * geo.WGS84_A / cf * F.cos(steep)
    sy, sx = F.sin(F.radians((south + north) * 0.5 - lat) * 0.5), F.sin(F.radians(middle) * 0.5)
    chord = F.sqrt(sy * sy + F.cos(F.radians((south + north) * 0.5)) * F.cos(F.radians(lat)) * sx * sx)
    widest = F.cos(F.radians(nearest_zero(south, north)))
    half = F.least(F.radians(g) * 0.5 * geo.EARTH_R * F.sqrt(1.0 + widest * widest), F.lit(geo.GLOBAL_REACH_M))
    steps = [
        {"_g": _side(F.col("level"))},
        {"_south": F.col("cy") * g - F.lit(90.0), "_middle": F.abs(short_way(F.col("cx") * g - F.lit(180.0) + g * 0.5 - F.col("site_lng")))},
        {"_north": F.least(south + g, F.lit(90.0))},
        # Mean latitudes of the site and points of the cell, farthest from the equator and nearest to it.
        {"_steep": F.radians(F.greatest(F.abs((lat + south) / 2.0), F.abs((lat + north) / 2.0))),
         "_flat": F.radians(nearest_zero((lat + south) / 2.0, (lat + north) / 2.0))},
        {"_cs": F.sqrt(1.0 - geo.WGS84_E2 * F.sin(steep) * F.sin(steep)), "_cf": F.sqrt(1.0 - geo.WGS84_E2 * F.sin(flat) * F.sin(flat))},
        {"_fy": far_y, "_fx": far_x, "_ny": near_y, "_nx": near_x, "_half": half,
         "_great": F.lit(2.0 * geo.EARTH_R) * F.asin(F.least(chord, F.lit(1.0)))},
        {"_fl": F.sqrt(F.col("_fx") * F.col("_fx") + F.col("_fy") * F.col("_fy")) * (1 + SLACK),
         "_nl": F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny")) * (1 - SLACK)}]
    df = cells
    for step in steps:
        df = df.withColumns(step)
    far = F.when(F.col("_fl") <= geo.NEAR_M, F.col("_fl")).otherwise(F.greatest(F.col("_great") + F.col("_half"), F.lit(1.01 * geo.NEAR_M)))
    near = F.when(F.col("_nl") <= geo.NEAR_M, F.col("_nl")).otherwise(F.greatest(F.lit(geo.NEAR_M), F.col("_great") - F.col("_half")))
    out = df.select("*", F.inline(F.array(F.struct((far + SLACK_M).alias("far"), (near - SLACK_M).alias("near")))))
    return out.select(*cells.columns, "far", "near")


def _drawn_in(cells: DataFrame, n: int) -> DataFrame:
    """``site_id, found_m``: the least distance within which cells that lie wholly inside hold ``n`` stores."""
    along = Window.partitionBy("site_id").orderBy("far").rangeBetween(Window.unboundedPreceding, 0)
    held = cells.withColumn("sum", F.sum("n").over(along))
    return held.groupBy("site_id").agg(F.min(F.when(F.col("sum") >= n, F.col("far"))).alias("found_m"))


def _first_radii(sites: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """``site_id, sk, site_lat, site_lng, radius_m`` from the cells around every site."""
    own = F.array(*[F.struct(F.lit(k).alias("level"), geo.cell_x(F.col("site_lng"), 360.0 / 2 ** k).alias("cx"),
                             geo.cell_y(F.col("site_lat"), 360.0 / 2 ** k).alias("cy")) for k in LEVELS])
    chain = sites.select("site_id", "sk", F.inline(own))
    deepest = chain.join(tree, KEY).filter(F.col("n") >= n).groupBy("site_id").agg(F.max("level").alias("deepest"))
    known = sites.join(deepest, "site_id")
    around = known.withColumn("level", F.explode(F.array_distinct(F.array("deepest", F.least(F.col("deepest") + STEP, F.lit(DEEPEST))))))
    g = _side(F.col("level"))
    columns = F.pow(F.lit(2.0), "level").cast("long")
    beside = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                         lambda d: F.pmod(F.floor((F.col("site_lng") + 180.0) / g).cast("long") + d, columns))
    around = around.withColumn("cx", F.explode(F.array_distinct(beside))) \
        .withColumn("cy", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: geo.cell_y(F.col("site_lat"), g) + d)))
    # At most 18 cells a site, in one group.
    near = _with_spans(around.join(tree, KEY)).groupBy("site_id").agg(F.collect_list(F.struct("far", "n", "level")).alias("cells"))

    def enough(cells: Column) -> Column:
        """The least distance within which cells lie that hold ``n`` stores."""
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("double").alias("found"))
        return F.aggregate(F.array_sort(cells), start, lambda s, c: F.struct(
            (s["sum"] + c["n"]).alias("sum"),
            F.when(s["found"].isNull() & (s["sum"] + c["n"] >= n), c["far"]).otherwise(s["found"]).alias("found")))["found"]

    coarse = F.array_min(F.transform("cells", lambda c: c["level"]))
    found = near.withColumn("coarse", coarse).select("site_id", F.least(
        enough(F.filter("cells", lambda c: c["level"] == F.col("coarse"))),
        enough(F.filter("cells", lambda c: c["level"] > F.col("coarse")))).alias("found_m"))
    return sites.join(found, "site_id", "left").select(
        "site_id", "sk", "site_lat", "site_lng", F.coalesce("found_m", F.lit(geo.GLOBAL_REACH_M)).alias("radius_m"))


def _covering(radii: DataFrame, tree: DataFrame) -> DataFrame:
    """The cells with stores that each circle touches, of about its size: site columns, radius, cell, n, far, near."""
    reach = geo.lat_reach_deg(F.col("radius_m"))
    # Finest level whose cells are at least half the circle's half-height, and not much smaller than its half-width.
    need = F.greatest(reach / 2.0, geo.lng_reach_deg(F.col("site_lat"), F.col("radius_m")) / 8.0)
    level = F.greatest(F.least(F.floor(F.log2(F.lit(360.0) / need) / STEP) * STEP, F.lit(DEEPEST)), F.lit(0)).cast("int")
    sized = radii.withColumn("level", level)
    g = _side(F.col("level"))
    cells = sized.withColumn("cy", F.explode(geo.covering_rows(F.col("site_lat"), F.col("radius_m"), g))) \
        .withColumn("cx", F.explode(geo.covering_cols(F.col("site_lat"), F.col("site_lng"), F.col("radius_m"), g)))
    return _with_spans(cells.join(tree, KEY)).filter(F.col("near") <= F.col("radius_m"))


def _split(cells: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """Open cells one step deeper, with the radius drawn in and cells beyond it dropped."""
    inner = F.explode(F.sequence(F.lit(0), F.lit(2 ** STEP - 1)))
    smaller = cells.select("site_id", "sk", "site_lat", "site_lng", "radius_m", (F.col("level") + STEP).alias("level"),
                           F.shiftleft("cx", STEP).alias("x"), F.shiftleft("cy", STEP).alias("y")) \
        .withColumn("dx", inner).withColumn("dy", inner) \
        .withColumn("cx", F.col("x") + F.col("dx")).withColumn("cy", F.col("y") + F.col("dy")).drop("x", "y", "dx", "dy")
    held = _with_spans(smaller.join(tree, KEY))
    found = _drawn_in(held, n)
    return held.join(found, "site_id").withColumn("radius_m", F.least("radius_m", F.coalesce("found_m", F.col("radius_m")))).drop("found_m") \
        .filter(F.col("near") <= F.col("radius_m"))


def search_radii(sites: DataFrame, stores: DataFrame, n: int, match_sector: bool = True, crowded: int = CROWDED) -> DataFrame:
    """``site_id, radius_m`` that surely holds the ``n`` nearest matching stores."""
    return _search(sites, stores, n, match_sector, crowded)[0]


def _search(sites: DataFrame, stores: DataFrame, n: int, match_sector: bool, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """The radii, and ``site_id, sk, level, cx, cy`` of the cells whose stores a site has to look at."""
    ensure_checkpoint_dir(sites.sparkSession)
    wanted = F.coalesce(F.col("site_sector"), F.lit(ANY_SECTOR)) if match_sector else F.lit(ANY_SECTOR)
    asked = sites.select("site_id", wanted.alias("sk"), "site_lat", "site_lng")
    tree = count_tree(stores, match_sector).checkpoint()
    radii = _first_radii(asked, tree, n).checkpoint()
    cells = _covering(radii, tree).checkpoint()
    drawn, left = [], []
    while True:
        full = cells.groupBy("site_id").agg(F.sum("n").alias("held"), F.min("level").alias("depth")) \
            .filter((F.col("held") > crowded * n) & (F.col("depth") < DEEPEST)).select("site_id")
        left.append(cells.join(full, "site_id", "left_anti").select("site_id", *KEY))
        cells = _split(cells.join(full, "site_id", "left_semi"), tree, n).checkpoint()
        if cells.isEmpty():
            break
        drawn.append(cells.select("site_id", F.col("radius_m").alias("closer_m")).distinct())
    out = radii.select("site_id", "radius_m")
    for closer in drawn:  # at most one round a level
        out = out.join(closer, "site_id", "left").select("site_id", F.least("radius_m", F.coalesce("closer_m", "radius_m")).alias("radius_m"))
    return out, reduce(DataFrame.unionByName, left).distinct()


def _pairs(sites: DataFrame, cells: DataFrame, stores: DataFrame, match_sector: bool) -> DataFrame:
    """Sites (prepared, with ``radius_m`` and ``sk``) and the stores of their cells within the radius."""
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # at most one a level
    if not levels:
        levels = [DEEPEST]
    sector = F.array(F.col("sector"), F.lit(ANY_SECTOR)) if match_sector else F.array(F.lit(ANY_SECTOR))
    smallest = 360.0 / 2 ** DEEPEST
    st = stores.filter("lat is not null and lng is not null").select("*", F.explode(sector).alias("sk")).select(
        "*", F.inline(_up(geo.cell_x(F.col("lng"), smallest), geo.cell_y(F.col("lat"), smallest), levels)))
    if has_at_most(cells, DEFAULT_PLAN.broadcast_max_rows):
        met = st.join(F.broadcast(sites.join(cells, ["site_id", "sk"])), KEY)
    else:
        met = salted_join(sites.join(cells, ["site_id", "sk"]), st, DEFAULT_PLAN.hot_rows, KEY, DEFAULT_PLAN.hot_pairs)
    return with_distances(met.drop(*KEY), distance_m="global").filter(F.col("distance_m") <= F.col("radius_m"))


def nearest_stores(sites: DataFrame, stores: DataFrame, n: int = 5, match_sector: bool = True) -> DataFrame:
    """``site_id, rank, id, sector, distance_m`` for the ``n`` nearest stores
    (ties by store id; the site's sector when given).  A site with fewer than
    ``n`` matching stores in the whole table gets all of them."""
    st = stores.select("id", "sector", "lat", "lng")
    s = prepare_sites(sites.withColumn("radius_m", F.lit(0.0)))
    placed = s.filter("site_lat is not null and site_lng is not null").drop("radius_m")
    reach, cells = _search(placed, st, n, match_sector)
    wanted = F.coalesce(F.col("site_sector"), F.lit(ANY_SECTOR)) if match_sector else F.lit(ANY_SECTOR)
    pairs = _pairs(placed.join(reach.checkpoint(), "site_id").withColumn("sk", wanted), cells.checkpoint(), st, match_sector)
    w = Window.partitionBy("site_id").orderBy(F.col("distance_m"), F.col("id"))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n) \
        .select("site_id", F.col("rank").cast("long").alias("rank"), "id", "sector",
                round_half_up(F.col("distance_m")).alias("distance_m"))
