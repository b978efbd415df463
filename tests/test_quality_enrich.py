"""Site validation, quality split and geocoding branches on hand-made frames."""

import datetime as dt

from sitelens.operators import enrich as en
from sitelens.operators import quality as qa
from sitelens.sources.sites import SITE_SCHEMA

STORE = "id long, store_name string, sector string, address string, open_date date, close_date date, lat double, lng double"


def test_site_validation_reasons(spark):
    sites = spark.createDataFrame([
        (1, 37.5, 127.0, 500.0, "X"),      # valid
        (2, 100.0, 127.0, 500.0, None),    # lat out of range
        (3, 37.5, 200.0, 500.0, None),     # lng out of range
        (4, 37.5, 127.0, 0.0, None),       # radius too small
        (5, 37.5, 127.0, 20000.0, None),   # radius too large
        (6, 37.5, 127.0, 500.0, "  "),     # blank sector
    ], SITE_SCHEMA)
    got = {r["site_id"]: (r["is_valid"], r["reject_reasons"]) for r in qa.site_validation(sites).collect()}
    assert got[1] == (True, [])
    assert got[2] == (False, ["LAT_OUT_OF_RANGE"]) and got[3] == (False, ["LNG_OUT_OF_RANGE"])
    assert got[4][1] == got[5][1] == ["RADIUS_OUT_OF_RANGE"] and got[6] == (False, ["SECTOR_BLANK"])


def test_quality_split_keeps_every_row(spark):
    d = dt.date(2020, 1, 1)
    s = spark.createDataFrame([(1, "a", "X", "addr", d, None, 37.5, 127.0),
                               (2, "b", None, "addr", None, d, None, None)], STORE)
    out = {r["id"]: (r["status"], r["reject_reasons"]) for r in qa.quality_split(s).collect()}
    assert out == {1: ("valid", []), 2: ("rejected", ["SECTOR_NULL", "OPEN_DATE_NULL", "LOCATION_NULL"])}


def test_geocode_fills_only_missing_and_first_rank_wins(spark):
    d = dt.date(2020, 1, 1)
    stores = spark.createDataFrame([
        (1, "a", "X", "A st", d, None, None, None),     # filled from rank 1
        (2, "b", "X", "A st", d, None, 1.0, 2.0),       # already located: kept
        (3, "c", "X", "Z st", d, None, None, None),     # no answer: stays pending
        (4, "d", "X", None, d, None, None, None),       # no address: not pending
    ], STORE)
    coords = spark.createDataFrame([("A st", 2, 9.0, 9.0), ("A st", 1, 127.1, 37.6)],
                                   "address string, rank long, lng double, lat double")
    got = {r["id"]: (r["lat"], r["lng"], r["geocoded"]) for r in en.geocode_apply(stores, coords).collect()}
    assert got[1] == (37.6, 127.1, True) and got[2] == (1.0, 2.0, False)
    assert got[3] == (None, None, False) and got[4] == (None, None, False)
    rem = en.geocode_remaining(stores, coords).first()
    assert (rem["pending_before"], rem["geocoded"], rem["pending_after"]) == (2, 1, 1)
    b = en.geocode_batches(stores, coords, quota=10, batch_size=1).collect()
    assert [(r["id"], r["batch"], r["wkt"]) for r in b] == [(1, 0, "POINT(127.1 37.6)")]


def test_schemas_ddl_and_snapshot_append(spark, scratch):
    import os
    from sitelens import schemas
    from sitelens.operators import stores as so
    from sitelens.operators import survival as sv
    from sitelens.sources.store_view import store_view
    from tests.conftest import SF0001
    ddl = schemas.create_table_sql("survival_analysis", os.path.join(scratch, "sa"))
    assert "decimal(10,2)" in ddl and "USING parquet" in ddl
    stored = schemas.conform(sv.survival_table(sv.survival_batch(store_view(spark, SF0001)),
                                               dt.datetime(2001, 7, 1)), "survival_analysis")
    assert [f.dataType for f in stored.schema.fields] == [f.dataType for f in schemas.SURVIVAL_ANALYSIS.fields]
    path = os.path.join(scratch, "snap")
    snaps = so.opening_snapshots(store_view(spark, SF0001))
    schemas.append_snapshots(spark, snaps, path, dt.datetime(2001, 7, 1))
    back = spark.read.parquet(path)
    assert back.count() == snaps.count() and back.columns == [f.name for f in schemas.STORE_OPENING_SNAPSHOT.fields]


def test_point_text_formats(spark):
    from pyspark.sql import functions as F
    from sitelens.functions import geo
    df = spark.createDataFrame([('{"type":"Point","coordinates":[126.98,37.5]}',), ('{"type":"LineString"}',),
                                ("not json",), (None,)], "t string")
    lat, lng = geo.geojson_parse(F.col("t"))
    got = [(r["lat"], r["lng"]) for r in df.select(lat.alias("lat"), lng.alias("lng")).collect()]
    assert got == [(37.5, 126.98), (None, None), (None, None), (None, None)]
    pts = spark.createDataFrame([(37.5, 126.98), (-0.000000001, 180.0), (1e-10, -1.5)], "lat double, lng double")
    txt = [r[0] for r in pts.select(geo.geojson_build(F.col("lat"), F.col("lng"))).collect()]
    assert txt == ['{"type":"Point","coordinates":[126.98,37.5]}', '{"type":"Point","coordinates":[180,-0.000000001]}',
                   '{"type":"Point","coordinates":[-1.5,0]}']
    w = pts.select(geo.wkt_build(F.col("lat"), F.col("lng")).alias("w"))
    back = w.select(*geo.wkt_parse(F.col("w"))).collect()
    assert [tuple(r) for r in back] == [(37.5, 126.98), (-0.000000001, 180.0), (1e-10, -1.5)]
