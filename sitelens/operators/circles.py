"""Sums over, and first stores of, circles without looking at every pair inside.

A circle of a city may hold a share of all stores, so pairs grow with stores x
sites.  Here sites and stores meet per grid cell (cells at least as wide as
the circles, split by hash where they hold too many rows of a side), and a
cell's stores are cut into strips: about sqrt(2 n) runs of equal length along
the latitude, each sorted by longitude.  The part of a strip that surely lies
inside a circle is one interval, known by two searches; only stores near the
edge are looked at, about sqrt(n) of n.

* ``circle_sums``: interval sums come from running totals.
* ``circle_first``: the first ``k`` in a given order (runs of stores in that
  order, twice as long each time, until a circle has ``k``), or the nearest or
  farthest ``k`` (circles or rings as wide as ``k`` stores need).

NumPy only rules out and counts what is safe: pairs within ``SLACK_M`` of the
edge are returned as pairs, and Spark decides them with the same distance
columns as the distance join.  Sites far to the poles or wider than 80 degrees
have no safe interval and look at each store of their cells.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelens.functions import geo
from sitelens.operators.distance_join import (ANY_SECTOR, DEFAULT_PLAN, KEY, SITE_COLS, _parallelism, needed_levels, site_cells,
                                              store_cells, usable_sites, with_distances)
from sitelens.session import ensure_checkpoint_dir, ship_package
from sitelens.sources.tables import has_at_most

# Cell sizes in degrees; a circle takes the finest that is at least its diameter.
GRID_LEVELS = tuple(360.0 / 2 ** k for k in range(3, 15))
MAX_ROWS = 0.5
# Most rows of a side that meet in one group, on average.  More sites copy the stores of their cell.
MAX_STORES, MAX_SITES = 400_000, 100_000
# Pairs this close to the edge are decided by Spark (metres, and a share of the radius).
SLACK_M, SLACK = 1e-4, 1e-9
# Strip and site pairs (times 4), or stores, worked on at once: arrays that stay in a core's cache.
CHUNK = 64_000
# Strips of this many times sqrt(n / 2) stores: a strip costs a site as much as some stores near the edge.
THICK = 2.5
# Columns of a strip with more stores than this are halved.
CROWDED = 16
# Rows in a circle or ring per row wanted, beyond which it is narrowed.
LOOSE = 4
# Most rows that the sites of a group that are looked at together want.
MAX_WANTED = 500_000
STRIDE, WIDE_DEG = 1024.0, 80.0


# ------------------------------------------------------------- inside a group

class Circles:
    """Sites of a group: places in degrees (longitude from the middle of the cell) and radii in metres."""

    def __init__(self, table: pa.Table, middle: float):
        self.lat, self.lng = _floats(table, "site_lat"), _around(_floats(table, "site_lng"), middle)
        self.radius = _floats(table, "radius_m")
        reach = self.radius / geo.LAT_SPAN_R * (180.0 / np.pi)
        far = np.abs(self.lat) + reach
        self.wide = (far >= 89.0) | (reach / np.cos(np.radians(np.minimum(far, 89.0))) >= WIDE_DEG)


def _floats(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float)


def _around(lng: np.ndarray, middle: float) -> np.ndarray:
    return (lng - middle + 180.0) % 360.0 - 180.0


def _distance(metric: str, lat1, lng1, lat2, lng2) -> np.ndarray:
    """``geo.METRIC_STEPS`` on arrays."""
    if metric == "haversine":
        sa, sb = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lng2 - lng1) / 2)
        a = np.minimum(sa * sa + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * sb * sb, 1.0)
        return geo.EARTH_R * 2.0 * np.arctan2(np.sqrt(a), np.sqrt(1.0 - a))
    mean = np.radians((lat1 + lat2) * 0.5)
    w = np.sqrt(1.0 - geo.WGS84_E2 * np.sin(mean) ** 2)
    dl = lng2 - lng1
    dl = np.where(dl > 180.0, dl - 360.0, np.where(dl < -180.0, dl + 360.0, dl))
    x = geo.WGS84_A * (1.0 - geo.WGS84_E2) / (w * w * w) * np.radians(lat2 - lat1)
    y = geo.WGS84_A / w * np.cos(mean) * np.radians(dl)
    return np.sqrt(x * x + y * y)


def _squared(metric: str, lat1, cos1, lng1, lat2, cos2, lng2) -> np.ndarray:
    """A number that grows with the distance, without its roots and arcs: ``_limit`` is the same of a radius."""
    if metric == "haversine":
        sa, sb = np.sin((lat2 - lat1) * (np.pi / 360.0)), np.sin((lng2 - lng1) * (np.pi / 360.0))
        return sa * sa + cos1 * cos2 * (sb * sb)
    sin = np.sin((lat1 + lat2) * (np.pi / 360.0))
    sin *= sin
    w = 1.0 / (1.0 - geo.WGS84_E2 * sin)
    dl = np.abs(lng2 - lng1)
    if len(dl) and dl.max() > 180.0:
        dl = np.where(dl > 180.0, 360.0 - dl, dl)
    x, y = (lat2 - lat1) * (1.0 - geo.WGS84_E2) * w, dl
    return (x * x + (1.0 - sin) * (y * y)) * w


def _limit(metric: str, radius: np.ndarray) -> np.ndarray:
    """``_squared`` at ``radius`` metres; -1 below 0."""
    if metric == "haversine":
        out = np.sin(np.minimum(radius / (2 * geo.EARTH_R), np.pi / 2)) ** 2
        return np.where(radius < 0, -1.0, np.where(radius >= np.pi * geo.EARTH_R, 2.0, out))
    return np.where(radius < 0, -1.0, (radius * (180.0 / np.pi) / geo.WGS84_A) ** 2)


def _widths(metric: str, lat: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, ...]:
    """``p, q, P, Q`` of a circle: a store ``y`` degrees of latitude away is inside if its squared degrees of longitude
    are below ``p - q y^2`` and outside if they are above ``P - Q y^2``.  Each factor of the metric is taken at the end
    of its range over the circle."""
    reach = np.radians(radius / geo.LAT_SPAN_R * (180.0 / np.pi) + 1e-8)
    lat = np.radians(lat)

    def ends(half):
        low, high = np.abs(lat - half), np.abs(lat + half)
        return np.where(np.abs(lat) <= half, 0.0, np.minimum(low, high)), np.maximum(low, high)

    if metric == "haversine":
        whole, (flat, steep) = 4.0 * _limit(metric, radius), ends(reach)
        wide = 1.2 * reach / np.cos(steep)
        x0, x1 = 1.0 - reach ** 2 / 12.0, 1.0
        y0, y1 = np.cos(lat) * np.cos(steep) * (1.0 - wide ** 2 / 12.0), np.cos(lat) * np.cos(flat)
    else:
        whole, (flat, steep) = radius ** 2, ends(reach / 2.0)
        w0, w1 = 1.0 - geo.WGS84_E2 * np.sin(flat) ** 2, 1.0 - geo.WGS84_E2 * np.sin(steep) ** 2
        meridian = (geo.WGS84_A * (1.0 - geo.WGS84_E2)) ** 2
        x0, x1 = meridian / w0 ** 3, meridian / w1 ** 3
        y0, y1 = geo.WGS84_A ** 2 / w1 * np.cos(steep) ** 2, geo.WGS84_A ** 2 / w0 * np.cos(flat) ** 2
    squared = (180.0 / np.pi) ** 2
    return (whole / y1 * squared * (1 - 1e-12), x1 / y1 * (1 + 1e-12), whole / y0 * squared * (1 + 1e-12), x0 / y0 * (1 - 1e-12))


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number) of every whole number of the ranges."""
    sizes = np.maximum(ends - starts, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Strips:
    """Stores in runs along the latitude, each sorted by longitude; ``rows`` are their places in the input.

    Places of longitudes come from a table of columns of equal width, as many per strip as it has stores; columns
    that hold many stores are halved by comparisons."""

    def __init__(self, lat: np.ndarray, lng: np.ndarray, rows: np.ndarray, metrics: tuple[str, ...]):
        n, self.metrics = len(rows), metrics
        size = max(int(THICK * np.sqrt(n / 2)), 16)
        along = np.argsort(lat[rows], kind="stable")
        strip = np.arange(n) // size
        sorted_lat = lat[rows][along]
        self.low, self.high = sorted_lat[::size], sorted_lat[np.minimum(np.arange(size - 1, n + size - 1, size), n - 1)]
        order = along[np.lexsort((lng[rows][along], strip))]
        self.rows, self.size = rows[order], size
        self.lat, self.lng = lat[self.rows], lng[self.rows]
        self.cos = np.cos(np.radians(self.lat))
        self.off_earth = bool(n and (self.low[0] < -90.0 or self.high[-1] > 90.0))
        ends = np.minimum(np.arange(size, n + size, size), n)
        self.west = self.lng[::size]
        self.scale = size * (1 - 1e-9) / np.maximum(self.lng[ends - 1] - self.west, 1e-12)
        held = np.bincount(strip * (size + 3) + self._column(strip, self.lng), minlength=len(ends) * (size + 3))
        self.columns = np.concatenate([[0], np.cumsum(held)])[:-1]
        self.steps = max(int(held.max()) // CROWDED, 0).bit_length() if n else 0

    def _column(self, strip: np.ndarray, lng: np.ndarray) -> np.ndarray:
        """Column of a longitude, never falling as it grows; 0: west of the strip, ``size`` + 1: east of it."""
        return (np.clip((lng - self.west[strip]) * self.scale[strip], -1.0, self.size) + 1.0).astype(np.int64)

    def places(self, strip: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places between which the first store of the strip at ``lng`` or east of it lies."""
        at = strip * (self.size + 3) + self._column(strip, lng)
        a, b = self.columns[at], self.columns[at + 1]
        for _ in range(self.steps):
            half = (a + b) >> 1
            open_ = a < b
            west = open_ & (self.lng[np.minimum(half, len(self.lng) - 1)] < lng)
            a, b = np.where(west, half + 1, a), np.where(open_ & ~west, half, b)
        return a, b

    def distance(self, metric: str, c: Circles, site: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _distance(metric, c.lat[site], c.lng[site], self.lat[at], self.lng[at])

    def chunks(self, c: Circles, sites: np.ndarray, radius: np.ndarray):
        """(sites, their radii, first strip, end) in parts of bounded work."""
        reach = radius / geo.LAT_SPAN_R * (180.0 / np.pi) + 1e-8
        first = np.searchsorted(self.high, c.lat[sites] - reach, "left")
        end = np.searchsorted(self.low, c.lat[sites] + reach, "right")
        work = np.cumsum(np.maximum(end - first, 0) * np.where(c.wide[sites], self.size, 4) + 1)
        part = work // CHUNK
        for x in np.split(np.arange(len(sites)), np.flatnonzero(np.diff(part)) + 1):
            if len(x):
                yield x, sites[x], radius[x], first[x], end[x]

    def spans(self, c: Circles, sites: np.ndarray, radius: np.ndarray, first: np.ndarray, end: np.ndarray):
        """Per site and strip: owner and places ``o0 <= i0 <= i1 <= o1``; [i0, i1) is inside, the rest of [o0, o1) open."""
        owner, strip = _spread(first, end)
        lat, lng = c.lat[sites], c.lng[sites][owner]
        above, below = self.high[strip] - lat[owner], lat[owner] - self.low[strip]
        far, near = np.maximum(above, below), np.maximum(np.maximum(-above, -below), 0.0)
        far *= far
        near *= near
        inner = outer = None
        for m in self.metrics:
            with np.errstate(divide="ignore", invalid="ignore"):
                p, q, p_out, q_out = _widths(m, lat, radius)
                i, o = p[owner] - q[owner] * far, p_out[owner] - q_out[owner] * near
            inner, outer = (i, o) if inner is None else (np.minimum(inner, i), np.maximum(outer, o))
        if self.off_earth or c.wide[sites].any():
            odd = c.wide[sites][owner] | (self.low[strip] < -90.0) | (self.high[strip] > 90.0)
            inner, outer = np.where(odd, -1.0, inner), np.where(odd, 1e12, outer)
        none = ~(inner > 0)
        inner = np.sqrt(np.maximum(inner, 0.0)) * (1 - 1e-9) - 1e-8
        outer = np.sqrt(np.maximum(outer, 0.0)) * (1 + 1e-9) + 1e-8
        o0, o1 = self.places(strip, lng - outer)[0], self.places(strip, lng + outer)[1]
        i0, i1 = self.places(strip, lng - inner)[1], self.places(strip, lng + inner)[0]
        none |= i1 <= i0
        return owner, o0, np.where(none, o1, i0), np.where(none, o1, i1), o1

    def sums(self, c: Circles, sites: np.ndarray, radius: np.ndarray, values: np.ndarray, of: list[str]):
        """Sums of the columns ``values`` (``of``: the metric of each) over safe stores, and the (site, store row) pairs left."""
        values = values[self.rows]
        total = np.concatenate([np.zeros((1, values.shape[1]), np.int64), np.cumsum(values, axis=0)])
        columns = [np.ascontiguousarray(values[:, j]) for j in range(values.shape[1])]
        out, left_site, left_row = np.zeros((len(sites), values.shape[1]), np.int64), [], []
        for x, s, r, first, end in self.chunks(c, sites, radius):
            owner, o0, i0, i1, o1 = self.spans(c, s, r, first, end)
            some = np.flatnonzero(end > first)
            if not len(some):
                continue
            begins = np.cumsum(end[some] - first[some]) - (end[some] - first[some])
            out[x[some]] += np.add.reduceat(total[i1] - total[i0], begins, axis=0)
            slack = SLACK_M + SLACK * r
            limits = {m: (_limit(m, r - slack), _limit(m, r + slack)) for m in self.metrics}
            lat, lng, cos = c.lat[s], c.lng[s], np.cos(np.radians(c.lat[s]))
            for a, b in ((o0, i0), (i1, o1)):
                span, at = _spread(a, b)
                mine = owner[span]
                place = lat[mine], cos[mine], lng[mine], self.lat[at], self.cos[at], self.lng[at]
                sure, unsure = {}, np.zeros(len(at), bool)
                for m in self.metrics:
                    d = _squared(m, *place)
                    sure[m] = d < limits[m][0][mine]
                    unsure |= ~sure[m] & (d <= limits[m][1][mine])
                if unsure.any():
                    left_site.append(s[mine[unsure]])
                    left_row.append(self.rows[at[unsure]])
                    sure = {m: v & ~unsure for m, v in sure.items()}
                inside = {m: (mine[v], at[v]) for m, v in sure.items()}
                for j, m in enumerate(of):
                    out[x, j] += np.bincount(inside[m][0], columns[j][inside[m][1]], len(x)).astype(np.int64)
        return out, _joined(left_site), _joined(left_row)

    def counts(self, c: Circles, sites: np.ndarray, radius: np.ndarray) -> np.ndarray:
        return self.sums(c, sites, radius, np.ones((int(self.rows.max()) + 1, 1), np.int64), [self.metrics[0]])[0][:, 0]

    def listed(self, c: Circles, sites: np.ndarray, radius: np.ndarray, hollow: np.ndarray | None = None):
        """(site, store row, distance) in parts: all stores up to the radius and from ``hollow`` on, slack included."""
        metric = self.metrics[0]
        for x, s, r, first, end in self.chunks(c, sites, radius):
            owner, o0, i0, i1, o1 = self.spans(c, s, r, first, end)
            parts = [(o0, o1)]
            if hollow is not None:
                _, h0, g0, g1, h1 = self.spans(c, s, np.maximum(hollow[x], 0.0), first, end)
                none = (hollow[x][owner] <= 0) | (g1 <= g0)
                parts = [(o0, np.where(none, o1, g0)), (np.where(none, o1, g1), o1)]
            for a, b in parts:
                for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(b - a) // CHUNK)) + 1):
                    span, at = _spread(a[part], b[part])
                    mine = owner[part][span]
                    d = self.distance(metric, c, s[mine], at)
                    slack = SLACK_M + SLACK * r[mine]
                    keep = d <= r[mine] + slack
                    if hollow is not None:
                        keep &= d >= hollow[x][mine] - slack
                    yield s[mine[keep]], self.rows[at[keep]], d[keep]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _all_listed(found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(found)
    return tuple(_joined([p[i] for p in parts]) for i in range(3))


def _first_in_order(strips, c: Circles, k: int, n: int):
    """(site, row) of the first ``k`` rows of each circle, rows being numbered in order; open ones among them come along."""
    out_site, out_row = [], []
    need = np.full(len(c.lat), k, np.int64)

    def run(lo: int, hi: int) -> None:
        sites = np.flatnonzero(need > 0)
        if not len(sites) or lo >= hi:
            return
        s = strips(np.arange(lo, hi))
        if hi - lo > 2 * k and s.counts(c, sites, c.radius[sites]).sum() > LOOSE * k * len(sites):
            run(lo, (lo + hi) // 2)
            run((lo + hi) // 2, hi)
            return
        site, row, d = _all_listed(s.listed(c, sites, c.radius[sites]))
        order = np.lexsort((row, site))
        site, row, d = site[order], row[order], d[order]
        sure = d < c.radius[site] - SLACK_M - SLACK * c.radius[site]
        seen = np.cumsum(sure) - sure
        begins = np.searchsorted(site, site, "left")
        keep = seen - seen[begins] < need[site]
        out_site.append(site[keep])
        out_row.append(row[keep])
        np.subtract.at(need, site[keep & sure], 1)

    lo, step = 0, max(16 * k, 512)
    while lo < n:
        run(lo, min(lo + step, n))
        lo, step = lo + step, step * 2
    return _joined(out_site), _joined(out_row)


def _by_distance(s: Strips, c: Circles, k: int, farthest: bool, lat: np.ndarray, lng: np.ndarray, ids: np.ndarray):
    """(site, row) of the nearest or farthest ``k`` rows of each circle, ties and open ones included."""
    sites, r = np.arange(len(c.lat)), c.radius
    total = s.counts(c, sites, r)
    slack = SLACK_M + SLACK * r
    # ``width``: radius of the inner circle, or width of the ring at the edge; it is narrowed between low and high.
    share = np.clip(2.0 * k / np.maximum(total, 1), 0.0, 1.0)
    width = np.where(farthest, r * (1.0 - np.sqrt(1.0 - share)), r * np.sqrt(share)) + slack
    low, high = np.zeros(len(r)), r.copy()
    width = np.where(total <= LOOSE * k, r, np.minimum(width, r))
    todo = np.flatnonzero(total > LOOSE * k)
    for _ in range(40):
        if not len(todo):
            break
        w = width[todo]
        if farthest:
            held = total[todo] - s.counts(c, todo, np.maximum(r[todo] - w, 0.0))
        else:
            held = s.counts(c, todo, w)
        few, many = held < k, held > LOOSE * k
        low[todo[few]], high[todo[~few]] = w[few], w[~few]
        tried = np.where(few, np.minimum(np.where(high[todo] < r[todo], (low[todo] + high[todo]) / 2, 2 * w), r[todo]), (low[todo] + w) / 2)
        open_ = (few & (w < r[todo])) | (many & (high[todo] - low[todo] > 4 * slack[todo]))
        width[todo[open_]] = tried[open_]
        todo = todo[open_]
    width[todo] = high[todo]
    # Twice the slack: what was counted as inside the narrower circle, and ties at its edge, are listed.
    width = np.where(width < r, np.minimum(width + 2 * slack, r), r)
    found = s.listed(c, sites, r, np.where(width < r, r - width, 0.0)) if farthest else s.listed(c, sites, width)
    out_site, out_row = [], []
    for site, row, d in _whole_sites(found):
        # Of many rows at one place only the k smallest ids can be wanted.
        order = np.lexsort((ids[row], lng[row], lat[row], site))
        site, row, d = site[order], row[order], d[order]
        new = np.concatenate([[True], (np.diff(site) != 0) | (np.diff(lat[row]) != 0) | (np.diff(lng[row]) != 0)])
        begins = np.maximum.accumulate(np.where(new, np.arange(len(site)), 0))
        keep = np.arange(len(site)) - begins < k
        site, row, d = site[keep], row[keep], d[keep]
        order = np.lexsort((-d if farthest else d, site))
        site, row, d = site[order], row[order], d[order]
        sure = d < r[site] - slack[site]
        seen = np.cumsum(sure) - sure
        seen = seen - seen[np.searchsorted(site, site, "left")]
        # The distance of the k-th sure row bounds the rest.
        last = np.full(len(r), -np.inf if farthest else np.inf)
        kth = sure & (seen == k - 1)
        last[site[kth]] = d[kth]
        keep = d >= last[site] - 2 * slack[site] if farthest else d <= last[site] + 2 * slack[site]
        out_site.append(site[keep])
        out_row.append(row[keep])
    return _joined(out_site), _joined(out_row)


def _whole_sites(found):
    site, row, d = _all_listed(found)
    if len(site):
        yield site, row, d


# ------------------------------------------------------------------ in Spark

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, *names: str, partial: bool = False) -> DataFrame:
    """``df`` written once as a table in the shared folder; the shuffle files made for it are given back.  ``names``:
    the table's folder, a new one if none is given; with ``partial`` the rows are added to it."""
    spark = df.sparkSession
    path = "/".join([ensure_checkpoint_dir(spark), *(names or [f"rows-{uuid.uuid4().hex}"])])
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.mode("append" if partial else "errorifexists").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before) if before is not None else spark.conf.unset(FREE_SHUFFLES)
    return spark.read.schema(df.schema).parquet(path)


def located(stores: DataFrame) -> DataFrame:
    """Stores with a place, written once as a table in the shared folder (callers that ask more than one thing of
    them then give ``stored``)."""
    return written(stores.filter("lat is not null and lng is not null"), f"stores-{uuid.uuid4().hex}")


def _met(sites: DataFrame, stores: DataFrame, match_sector: bool, max_stores: int, max_sites: int, stored: bool):
    """Both sides with their cells and salts, the levels, and the key they meet by."""
    spark = stores.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    sites = usable_sites(sites)
    levels, _ = needed_levels(sites, GRID_LEVELS, MAX_ROWS)
    # Read three times below: written once.
    stores = (stores if stored else located(stores)).filter("not isnan(lat) and not isnan(lng)")
    sc = site_cells(sites, levels, MAX_ROWS).select(*SITE_COLS, *KEY)
    st = store_cells(stores, levels)
    key = list(KEY)
    if match_sector:
        key.append("sk")
        sc = sc.withColumn("sk", F.coalesce(F.col("site_sector"), F.lit(ANY_SECTOR)))
        st = st.withColumn("sk", F.explode(F.array(F.col("sector"), F.lit(ANY_SECTOR)))).filter("sk is not null")
    count = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    buckets = lambda n, most: F.greatest(F.ceil(F.col(n) / F.lit(float(most))), F.lit(1)).cast("int")
    hot = count(st, "n_st").join(count(sc, "n_sc"), key).filter((F.col("n_st") > max_stores) | (F.col("n_sc") > max_sites)) \
        .select(*key, buckets("n_st", max_stores).alias("nb"), buckets("n_sc", max_sites).alias("na")).checkpoint()
    if has_at_most(hot, DEFAULT_PLAN.broadcast_max_rows):
        hot = F.broadcast(hot)
    st, sc = st.join(hot, key, "left"), sc.join(hot, key, "left")
    one, wide = F.lit(1), lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    st = st.withColumn("salt_b", F.pmod(F.xxhash64("id"), F.coalesce("nb", one)).cast("int")).withColumn("salt_a", wide("na"))
    sc = sc.withColumn("salt_a", F.pmod(F.xxhash64("site_id", "site_lat", "site_lng"), F.coalesce("na", one)).cast("int")) \
        .withColumn("salt_b", wide("nb"))
    key += ["salt_a", "salt_b"]
    return sc.drop("na", "nb"), st.drop("na", "nb"), levels, key


def _group(key: tuple, site_table: pa.Table, store_table: pa.Table, levels: tuple[float, ...]):
    level, cx = key[0].as_py(), key[1].as_py()
    middle = -180.0 + (cx + 0.5) * levels[level]
    return (Circles(site_table, middle), _floats(store_table, "lat"), _around(_floats(store_table, "lng"), middle))


def circle_sums(sites: DataFrame, stores: DataFrame, measures: dict[str, tuple[str, Column]], match_sector: bool = True,
                by: str | None = None, max_stores: int = MAX_STORES, max_sites: int = MAX_SITES, stored: bool = False) -> DataFrame:
    """Parts of the sums of ``measures`` (name: metric, whole number of a store) over every site's circle: the
    site columns, ``by`` if given, and the measures, to be added up by the caller.  ``sites`` must be prepared."""
    names = list(measures)
    of = [measures[m][0] for m in names]
    metrics = tuple(dict.fromkeys(of))
    cols = [F.coalesce(measures[m][1].cast("long"), F.lit(0).cast("long")).alias(m) for m in names]
    wanted = list(dict.fromkeys(["id", "lat", "lng", "sector", *([by] if by else [])]))
    sc, st, levels, key = _met(sites, stores.select(*wanted, *cols), match_sector, max_stores, max_sites, stored)
    by_type = [st.schema[by]] if by else []
    schema = StructType([*[sc.schema[c] for c in SITE_COLS], *by_type, st.schema["lat"], st.schema["lng"], *[st.schema[m] for m in names]])

    def run(k, site_table: pa.Table, store_table: pa.Table) -> pa.Table:
        out = []
        site_table = site_table.select(SITE_COLS)
        if site_table.num_rows and store_table.num_rows:
            c, lat, lng = _group(k, site_table, store_table, levels)
            values = np.stack([store_table.column(m).to_numpy() for m in names], axis=1)
            code = np.zeros(len(lat), np.int64)
            kinds = pa.array([None])
            if by:
                coded = store_table.column(by).combine_chunks().dictionary_encode(null_encoding="encode")
                code, kinds = coded.indices.to_numpy(), coded.dictionary
            everyone = np.arange(len(c.lat))
            for kind in np.unique(code):
                strips = Strips(lat, lng, np.flatnonzero(code == kind), metrics)
                total, site, row = strips.sums(c, everyone, c.radius, values, of)
                some = np.flatnonzero(total.any(axis=1))
                for s, place, v in ((some, None, total[some]), (site, row, values[row])):
                    t = site_table.take(pa.array(s))
                    if by:
                        t = t.append_column(by, pa.chunked_array([pa.repeat(kinds[int(kind)], len(s))], kinds.type))
                    for name in ("lat", "lng"):
                        t = t.append_column(name, pa.nulls(len(s), pa.float64()) if place is None else store_table.column(name).take(pa.array(place)))
                    for j, m in enumerate(names):
                        t = t.append_column(m, pa.array(v[:, j]))
                    out.append(t)
        return pa.concat_tables(out) if out else _empty(schema)

    parts = _parallelism(st)
    found = sc.repartition(parts, *key).groupBy(*key).cogroup(st.repartition(parts, *key).groupBy(*key)).applyInArrow(run, schema)
    exact = with_distances(found, **{f"_d_{m}": m for m in metrics})
    return exact.select(*SITE_COLS, *([by] if by else []), *[
        F.when(F.col("lat").isNull() | (F.col(f"_d_{m}") <= F.col("radius_m")), F.col(n)).otherwise(F.lit(0)).alias(n) for n, m in zip(names, of)])


def _empty(schema: StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema).empty_table()


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers that sort as the values do, texts by their bytes, nulls first."""
    column = column.combine_chunks()
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    coded = column.dictionary_encode(null_encoding="encode")
    values = [(v is not None, v.encode() if isinstance(v, str) else v or 0) for v in coded.dictionary.to_pylist()]
    place = np.empty(len(values), np.int64)
    place[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))
    return place[coded.indices.to_numpy()]


def circle_first(sites: DataFrame, stores: DataFrame, k: int, order: list[Column] | None = None, farthest: bool = False,
                 match_sector: bool = True, max_stores: int = MAX_STORES, max_sites: int = MAX_SITES, stored: bool = False) -> DataFrame:
    """Pairs with ``distance_m <= radius_m`` (spheroid), among them the first ``k`` of every site: by ``order``
    (whole numbers or texts, never null, ascending, then id), or else by distance.  ``sites`` must be prepared.

    Every store column given travels with each pair; callers give the few that rank it.  The sites of a group are
    looked at in parts that want ``MAX_WANTED`` rows together, so many sites need no copies of their stores."""
    ranks = [f"_order_{i}" for i in range(len(order or []))]
    given = stores.select("*", *[o.alias(r) for o, r in zip(order or [], ranks)])
    sc, st, levels, key = _met(sites, given, match_sector, max_stores, max_sites, stored)
    shown, ordered = stores.columns, bool(order)
    site_cols = [c for c in SITE_COLS if c != "site_sector"]
    schema = StructType([*[sc.schema[c] for c in site_cols], *[st.schema[c] for c in shown]])

    most = max(MAX_WANTED // k, 1)

    def run(key_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(batches)
        of_store = both.column("_store")
        site_table, store_table = both.filter(pc.invert(of_store)).select(site_cols), both.filter(of_store).select([*shown, *ranks])
        del both
        if not (site_table.num_rows and store_table.num_rows):
            return
        _, lat, lng = _group(key_, site_table, store_table, levels)
        ids = numbers(store_table.column("id"))
        inorder = np.lexsort([ids, *[numbers(store_table.column(r)) for r in reversed(ranks)]]) if ordered else np.arange(len(lat))
        sorted_lat, sorted_lng, known = lat[inorder], lng[inorder], {}

        def strips(rows: np.ndarray) -> Strips:
            place = (rows[0], len(rows))
            if place not in known:
                known[place] = Strips(sorted_lat, sorted_lng, rows, ("spheroid",))
            return known[place]

        for first in range(0, site_table.num_rows, most):
            part = site_table.slice(first, most)
            c = _group(key_, part, store_table.slice(0, 0), levels)[0]
            if not ordered:
                site, row = _by_distance(strips(inorder), c, k, farthest, lat, lng, ids)
            else:
                site, row = _first_in_order(strips, c, k, len(lat))
            left = part.take(pa.array(site, pa.int64()))
            right = store_table.select(shown).take(pa.array(inorder[row.astype(np.int64)], pa.int64()))
            yield from pa.table([*left.columns, *right.columns], names=[*site_cols, *shown]).to_batches()

    no = lambda df, cols: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    sides = sc.select(F.lit(False).alias("_store"), *site_cols, *no(st, [*shown, *ranks]), *key).union(
        st.select(F.lit(True).alias("_store"), *no(sc, site_cols), *shown, *ranks, *key))
    found = sides.repartition(_parallelism(st), *key).groupBy(*key).applyInArrow(run, schema)
    return with_distances(found, distance_m="spheroid").filter(F.col("distance_m") <= F.col("radius_m"))
