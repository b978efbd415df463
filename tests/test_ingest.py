"""Permit CSV ingest and its streaming form, on files written here."""

import datetime as dt
import os

from pyspark.sql import functions as F

from sitelens.sources import permits as pm
from sitelens.streaming.permit_stream import start_permit_ingest, start_reject_ingest

HEADER = ["업소명", "업종명", "소재지도로명", "허가신고일", "폐업일자", "기타"]


def _write(path, lines, sep=","):
    with open(path, "wb") as f:
        f.write(("\n".join([sep.join(HEADER)] + lines) + "\n").encode("cp949"))


def test_read_permits_all_cases(spark, scratch):
    d = os.path.join(scratch, "in")
    os.makedirs(d)
    _write(os.path.join(d, "a.csv"), [
        "가게,한식,서울 중구 1,20230115,,x",          # good
        "둘째,카페,서울 중구 2,2023-01-15,2024/03/01,y",  # separators in dates
        "셋째,카페,서울 중구 3,2024/02/30,,z",        # impossible date -> NULL
        "넷째,카페,서울 중구 4,,,z",                  # blank date
        " ,카페,서울 중구 5,20230101,,z",             # blank name -> reject
        "다섯,카페,,20230101,,z",                      # missing address -> reject
        "짧은,분식,서울 중구 6",                       # short line: kept, null-padded
        "긴줄,a,서울 중구 7,20230101,,x,extra,more",   # long line -> reject
        "\"따옴,표\",c,서울 중구 8,2023 01 02,,y",     # quoted separator
    ])
    _write(os.path.join(d, "b2019.csv"), ["세미,콜론;한식;부산 1;20190505;20200101;q"], sep=";")
    with open(os.path.join(d, "c.csv"), "wb") as f:   # lacks 폐업일자 -> skipped and reported
        f.write("업소명,업종명,소재지도로명,허가신고일\n가게,한식,서울,20230101\n".encode("cp949"))
    paths = [os.path.join(d, x) for x in ("a.csv", "b2019.csv", "c.csv")]
    batch = pm.read_permits(spark, paths)
    stores = {r["store_name"]: r for r in batch.stores.collect()}
    assert set(stores) == {"가게", "둘째", "셋째", "넷째", "짧은", "따옴,표", "세미,콜론"}
    assert stores["가게"]["open_date"] == dt.date(2023, 1, 15) and stores["가게"]["close_date"] is None
    assert stores["둘째"]["close_date"] == dt.date(2024, 3, 1)
    assert stores["셋째"]["open_date"] is None and stores["넷째"]["open_date"] is None
    assert stores["짧은"]["address"] == "서울 중구 6" and stores["짧은"]["open_date"] is None
    assert stores["따옴,표"]["open_date"] == dt.date(2023, 1, 2)
    assert stores["세미,콜론"]["close_date"] == dt.date(2020, 1, 1)
    assert all(r["lat"] is None for r in stores.values())
    reasons = sorted(r["reason"] for r in batch.rejects.collect())
    assert reasons == ["ADDRESS_MISSING", "NAME_MISSING", "TOO_MANY_FIELDS"]
    missing = batch.missing.collect()
    assert len(missing) == 1 and missing[0]["path"].endswith("c.csv") and missing[0]["missing"] == ["폐업일자"]
    # ids are stable across runs
    again = {r["store_name"]: r["id"] for r in pm.read_permits(spark, paths).stores.collect()}
    assert again == {k: v["id"] for k, v in stores.items()}
    out = os.path.join(scratch, "store")
    pm.append_stores(batch.stores, out)
    pm.append_stores(batch.stores, out, dedupe=True)
    assert spark.read.parquet(out).count() == 14


def test_stream_ingest_exactly_once(spark, scratch):
    d = os.path.join(scratch, "drop")
    os.makedirs(d)
    _write(os.path.join(d, "p1.csv"), ["가게,한식,서울 1,20230115,,x", "긴줄,a,b,20230101,,x,extra"])
    table, ckpt = os.path.join(scratch, "t"), os.path.join(scratch, "ckpt")
    q = start_permit_ingest(spark, d, HEADER, table, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(table).count() == 1
    _write(os.path.join(d, "p2.csv"), ["둘째,카페,서울 2,20230115,,x"])
    q = start_permit_ingest(spark, d, HEADER, table, ckpt)
    q.awaitTermination(120)
    names = sorted(r["store_name"] for r in spark.read.parquet(table).select("store_name").collect())
    assert names == ["가게", "둘째"]  # p1 not appended twice


def test_store_table_roundtrip_and_pushdown(spark, scratch):
    from sitelens.operators import survival as sv
    from sitelens.sources.store_view import read_store_table, store_view, write_store_table
    from tests.conftest import SF0001
    view = store_view(spark, SF0001)
    path = os.path.join(scratch, "store_table")
    write_store_table(view, path, n_files=4)
    table = read_store_table(spark, path)
    assert table.count() == view.count()
    a = sorted(tuple(r) for r in sv.survival_by_sector(view).collect())
    b = sorted(tuple(r) for r in sv.survival_by_sector(table).collect())
    assert a == b
    plan = table.filter(F.col("sector") == "BUILDING")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sector,BUILDING)" in plan


def test_quotes_paths_ids_and_rejects(spark, scratch):
    d = os.path.join(scratch, "2019-archive [old]")  # 2019 in a folder is no separator rule
    os.makedirs(d)
    same = "쌍둥이,한식,서울 9,20230101,,x"
    _write(os.path.join(d, "서울 [a].csv"), ['"가 ""본점""",한식,서울 1,20230101,,x', '"나', '다",카페,서울 2,20230101,,y',
                                           "열림,한식,서울 3,20230101,,x", "닫힘,한식,서울 3,,20230101,x", same, same,
                                           '5" 피자,한식,서울 10,20230101,,x', '"끝,한식,서울 4'])
    paths = [os.path.join(d, "서울 [a].csv")]
    batch = pm.read_permits(spark, paths)
    rows = batch.stores.collect()
    assert sorted(r["store_name"] for r in rows) == ['5" 피자', '가 "본점"', "나\n다", "닫힘", "쌍둥이", "쌍둥이", "열림"]
    assert len({r["id"] for r in rows}) == 7
    assert {r["reason"] for r in batch.rejects.collect()} == {"OPEN_QUOTE"} and batch.missing.count() == 0
    table, ckpt = os.path.join(scratch, "rej"), os.path.join(scratch, "rejck")
    plain = os.path.join(scratch, "plain")
    os.makedirs(plain)
    _write(os.path.join(plain, "a.csv"), ["긴줄,a,b,20230101,,x,extra", "이름,a,,20230101,,x", "좋음,a,서울,20230101,,x"])
    start_reject_ingest(spark, plain, HEADER, table, ckpt).awaitTermination(120)
    assert sorted(r["reason"] for r in spark.read.parquet(table).collect()) == ["ADDRESS_MISSING", "TOO_MANY_FIELDS"]


def _records(text, sep=","):
    """Records of a CSV text, character by character."""
    out, now, quoted, start = [], "", False, True
    for c in text:
        if c == "\n" and not quoted:
            out.append(now)
            now, start = "", True
            continue
        if quoted:
            quoted = c != '"'
        elif c == '"' and (start or now.endswith('"') and was_quoted):
            quoted = True
        if not quoted and c != '"' and not start:
            was_quoted = False
        if start:
            was_quoted = c == '"'
        now, start = now + c, c == sep and not quoted
    return out, now


def test_records_over_lines_and_splits(spark, scratch):
    import random

    from sitelens.sources.csv_records import csv_records

    rng = random.Random(11)
    field = lambda: rng.choice(["a", 'b"c', "", "long" * rng.randrange(9), '"x"', '"p,q"', '"l\nm"', '"s""t\n\n,u"', '"\n"'])
    text = "h1,h2,h3\n" + "".join(",".join(field() for _ in range(3)) + "\n" for _ in range(400))
    text += '7" lone,first,1\n"이름",카페,"주소\n둘째,줄,셋,20230101,,\n끝",x\n'
    path = os.path.join(scratch, "r.csv")
    with open(path, "wb") as f:
        f.write((text + '"never,closed\nrow,2\n').encode("cp949"))
    want, rest = _records(text)
    assert rest == "" and any("\n" in w for w in want)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in (size, "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = csv_records(spark, [path], ",", "cp949").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(r.record for r in got if r.reason is None) == sorted(w for w in want[1:] if w.strip(" "))
        assert sorted(r.record for r in got if r.reason) == ['"never,closed', "row,2"]


def test_a_field_over_lines_makes_one_store(spark, scratch):
    path = os.path.join(scratch, "p.csv")
    _write(path, ['5" 피자,한식,서울 1,20230101,,x', '"이름",카페,"주소', '둘째,줄,셋,20230101,,', '끝",20230102,,x'])
    batch = pm.read_permits(spark, [path])
    assert {(r.store_name, r.address) for r in batch.stores.collect()} == {('5" 피자', "서울 1"), ("이름", "주소\n둘째,줄,셋,20230101,,\n끝")}
    assert batch.rejects.count() == 0
