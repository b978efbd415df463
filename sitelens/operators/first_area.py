"""The first area of every kind that a store lies in, where many areas may overlap.

Stores and the cell index of ``polygons.area_cells`` meet per cell in NumPy tasks.  A cell's areas of a kind are
sorted by id; those behind the first one that covers the whole cell are hidden and left out.  Stores are tested
against one area, then two, four, ... more, and leave with the first that holds them, so pairs of a store and the
other areas over it are never formed.  The test is the even-odd test of ``polygons``, operation by operation;
stores within ``SLACK_M`` of a circle's edge are returned as open and decided by Spark's distance.

Cells are dealt to tasks by hash, as many together as fill a task; a crowded cell is split by salts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelens.operators.circles import CHUNK, SLACK, SLACK_M, _distance, _empty, _floats, _joined, _spread, numbers
from sitelens.operators.distance_join import _parallelism, salt_sides, with_distances
from sitelens.session import ensure_checkpoint_dir, ship_package

# Most rows of a side that meet in one group, on average; areas tested at once.
MAX_ROWS, MAX_STEP = 200_000, 64
BITS = 24


def cell_number(level: Column, cx: Column, cy: Column) -> Column:
    """One whole number for a cell; rows and columns of the finest level have ``BITS`` bits."""
    return (level.cast("long") * F.lit(1 << BITS) + cx) * F.lit(1 << BITS) + cy


class Index:
    """Rows of the cell index in the order of cell, kind and area; ``rows`` are their places in the table."""

    def __init__(self, table: pa.Table):
        cell, kind = table.column("cell").to_numpy(), table.column("kind").to_numpy()
        order = np.lexsort((numbers(table.column("area_id")), kind, cell))
        self.rows, cell, self.kind = order, cell[order], kind[order]
        held = pc.fill_null(pc.list_value_length(table.column("edges")), 0).to_numpy().astype(np.int64)
        edges = pc.list_flatten(table.column("edges"))
        self.edges = [pc.struct_field(edges, i).to_numpy() for i in range(4)]
        self.first, self.held = (np.cumsum(held) - held)[order], held[order]
        column = lambda name: _floats(table, name)[order]
        self.west, self.south, self.size = column("west"), column("south"), 360.0 / 2.0 ** column("level")
        self.lat, self.lng, self.radius = column("site_lat"), column("site_lng"), column("radius_m")
        self.corner = pc.fill_null(table.column("corner"), False).to_numpy().astype(bool)[order]
        self.work = np.concatenate([[0], np.cumsum(self.held + 1)])
        new = np.concatenate([[True], (np.diff(cell) != 0) | (np.diff(self.kind) != 0)])
        self.start = np.flatnonzero(new)
        self.cell = cell[self.start]
        whole = self.corner & (self.held == 0) & np.isnan(self.radius)
        n = len(cell)
        behind = np.minimum.reduceat(np.where(whole, np.arange(n), n), self.start) + 1
        self.end = np.minimum(np.append(self.start[1:], n), behind)

    def holds(self, row: np.ndarray, lat: np.ndarray, lng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the area of an index row surely holds the place, and whether that is open."""
        inside, unsure = self.corner[row], np.zeros(len(row), bool)
        pair, edge = _spread(self.first[row], self.first[row] + self.held[row])
        if len(edge):
            alat, alng, blat, blng = (e[edge] for e in self.edges)
            r = row[pair]
            west, south, y = self.west[r], self.south[r], lat[pair]
            turns = (west + self.size[r] * 0.5 - lng[pair]) / 360.0
            x = lng[pair] + 360.0 * (np.sign(turns) * np.floor(np.abs(turns) + 0.5))
            with np.errstate(divide="ignore", invalid="ignore"):
                y_at = (blat - alat) * (west - alng) / (blng - alng) + alat
                x_at = (blng - alng) * (y - alat) / (blat - alat) + alng
                north = ((alng > west) != (blng > west)) & ((y_at > south) != (y_at > y))
                east = ((alat > y) != (blat > y)) & (x_at > west) & (x_at <= x)
            crossed = np.bincount(pair, north.astype(float) + east, len(row)).astype(np.int64)
            inside = inside ^ (crossed % 2 == 1)
        round_ = np.flatnonzero(~np.isnan(self.radius[row]))
        if len(round_):
            r = row[round_]
            d, slack = _distance("spheroid", self.lat[r], self.lng[r], lat[round_], lng[round_]), SLACK_M + SLACK * self.radius[r]
            inside[round_] = d < self.radius[r] - slack
            unsure[round_] = ~inside[round_] & (d <= self.radius[r] + slack)
        return inside, unsure

    def first_rows(self, cell: np.ndarray, lat: np.ndarray, lng: np.ndarray):
        """(store, index row, open) of the first area of each kind that holds a store, and of the open ones before it."""
        store, of = _spread(np.searchsorted(self.cell, cell, "left"), np.searchsorted(self.cell, cell, "right"))
        at, end, step, tested = self.start[of], self.end[of], 1, 0
        stores, rows, opens = [], [], []
        while len(store):
            stop = np.minimum(at + step, end)
            found = np.full(len(store), -1)
            part = np.cumsum(self.work[stop] - self.work[at]) // CHUNK
            for x in np.split(np.arange(len(store)), np.flatnonzero(np.diff(part)) + 1):
                owner, row = _spread(at[x], stop[x])
                tested += len(row)
                inside, unsure = self.holds(row, lat[store[x]][owner], lng[store[x]][owner])
                hit = np.flatnonzero(inside)
                hit = hit[np.diff(owner[hit], prepend=-1) != 0]
                found[x[owner[hit]]] = row[hit]
                if unsure.any():
                    stores.append(store[x][owner[unsure]])
                    rows.append(row[unsure])
                    opens.append(np.ones(len(rows[-1]), bool))
            some = found >= 0
            stores.append(store[some])
            rows.append(found[some])
            opens.append(np.zeros(len(rows[-1]), bool))
            left = ~some & (stop < end)
            store, at, end, step = store[left], stop[left], end[left], min(2 * step, MAX_STEP)
        self.tested = tested
        return _joined(stores), _joined(rows), _joined(opens).astype(bool)


def first_areas(index: DataFrame, stores: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``id, kind, area_id``: for each store (``id, lat, lng, cell``, a row a level in use) and ``kind`` of the areas the
    smallest ``area_id`` over it; a store may have some rows of a kind, of which the smallest counts.

    ``index``: ``area_cells`` with ``cell`` and ``kind``, counted below and therefore stored by the caller, as the stores."""
    ensure_checkpoint_dir(stores.sparkSession)
    ship_package(stores.sparkSession)
    buckets = max(_parallelism(stores), math.ceil(index.count() / max_rows), math.ceil(stores.count() / max_rows))
    st, sc = salt_sides(index, stores, max_rows, ["cell"], site_hash="area_id")
    dealt = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("cell", "salt_a", "salt_b"), F.lit(buckets)).cast("int")) \
        .withColumn("cell", (F.col("cell") * F.lit(1 << 10) + F.pmod(F.xxhash64("salt_a", "salt_b"), F.lit(1 << 10)))).drop("salt_a", "salt_b")
    st, sc = dealt(st), dealt(sc)
    circle = ["site_lat", "site_lng", "radius_m"]
    schema = StructType([st.schema["id"], sc.schema["kind"], sc.schema["area_id"], *[sc.schema[c] for c in circle], st.schema["lat"], st.schema["lng"]])

    def run(index_table: pa.Table, store_table: pa.Table) -> pa.Table:
        if not (index_table.num_rows and store_table.num_rows):
            return _empty(schema)
        i = Index(index_table)
        store, row, unsure = i.first_rows(store_table.column("cell").to_numpy(), _floats(store_table, "lat"), _floats(store_table, "lng"))
        s = store_table.select(["id", "lat", "lng"]).take(pa.array(store, pa.int64()))
        a = index_table.select(["kind", "area_id", *circle]).take(pa.array(i.rows[row.astype(np.int64)], pa.int64()))
        asked = [pc.if_else(pa.array(unsure), a.column(c), pa.scalar(None, pa.float64())) for c in circle]
        return pa.table([s.column("id"), a.column("kind"), a.column("area_id"), *asked, s.column("lat"), s.column("lng")], names=schema.names)

    found = sc.groupBy("bucket").cogroup(st.groupBy("bucket")).applyInArrow(run, schema)
    exact = with_distances(found, distance_m="spheroid")
    return exact.filter(F.col("radius_m").isNull() | (F.col("distance_m") <= F.col("radius_m"))).select("id", "kind", "area_id")
