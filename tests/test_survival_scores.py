"""Hand-made frames for every branch of survival, stage distribution,
upsert and site scores (the semantics decisions are named in the tests)."""

import datetime as dt

from pyspark.sql import functions as F

from sitelens.operators import scores as sc
from sitelens.operators import survival as sv
from sitelens.sources.sites import SITE_SCHEMA

STORE = "id long, store_name string, sector string, address string, open_date date, close_date date, lat double, lng double"
D = dt.date


def _stores(spark, rows):
    return spark.createDataFrame(rows, STORE)


def test_survival_drops_negative_and_missing_and_keeps_null_sector_group(spark):
    s = _stores(spark, [
        (1, "a", "X", "", D(2020, 1, 1), D(2020, 1, 11), None, None),   # 10 days
        (2, "b", "X", "", D(2020, 1, 1), D(2020, 1, 2), None, None),    # 1 day
        (3, "c", "X", "", D(2020, 2, 1), D(2020, 1, 1), None, None),    # negative -> dropped
        (4, "d", "X", "", None, D(2020, 1, 1), None, None),             # missing -> dropped
        (5, "e", None, "", D(2020, 1, 1), D(2020, 1, 4), None, None),   # NULL sector group (Q13)
        (6, "f", "Y", "", D(2020, 1, 1), None, None, None),             # open -> ignored
    ])
    got = {r["sector"]: (r["avg_duration_days"], r["sample_size"]) for r in sv.survival_by_sector(s).collect()}
    assert got == {"X": (5.5, 2), None: (3.0, 1)}
    batch = {r["sector"] for r in sv.survival_batch(s).collect()}
    assert batch == {"X"}  # the batch job drops NULL sectors
    drops = {r["sector"]: (r["n_closed"], r["n_missing_date"], r["n_negative"], r["n_used"])
             for r in sv.survival_drops(s).collect()}
    assert drops["X"] == (4, 1, 1, 2)


def test_round_half_up_like_math_round(spark):
    from sitelens.functions.numeric import round_half_up
    r = spark.range(1).select(round_half_up(F.lit(1.005)).alias("a"), round_half_up(F.lit(2.675)).alias("b"),
                              round_half_up(F.lit(-1.005)).alias("c")).first()
    # floor(x*100+0.5)/100 on binary doubles, as JS Math.round(x*100)/100
    assert (r["a"], r["b"], r["c"]) == (1.0, 2.68, -1.0)


def test_stage_boundaries_and_all_stages_present(spark):
    as_of = D(2020, 12, 31)
    ages = [0, 365, 366, 1095, 1096, 1825, 1826, 3650, 3651, 5000, -1]
    rows = [(i, "n", "S", "", as_of - dt.timedelta(days=a), None, None, None) for i, a in enumerate(ages)]
    rows.append((99, "n", "", "", as_of, None, None, None))  # empty sector left out
    s = _stores(spark, rows)
    long = sv.survival_distribution_long(s, as_of).orderBy("stage_order").collect()
    assert [r["count"] for r in long] == [2, 2, 2, 2, 2]
    assert [r["range"] for r in long] == [x[0] for x in sv.STAGES]
    assert all(r["total_count"] == 10 and r["percentage"] == 20.0 for r in long)
    nested = sv.survival_distribution(s, as_of).first()
    assert len(nested["stages"]) == 5 and nested["stages"][4]["stage"] == sv.STAGES[4][3]


def test_upsert_keeps_first_calculated_at(spark):
    t0, t1 = dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)
    old = spark.createDataFrame([("A", 10.0, 5, t0, t0), ("B", 20.0, 6, t0, t0)],
                                "sector string, avg_duration_days double, sample_size long, "
                                "calculated_at timestamp_ntz, updated_at timestamp_ntz")
    new = spark.createDataFrame([("A", 11.0, 7), ("C", 30.0, 1)],
                                "sector string, avg_duration_days double, sample_size long")
    got = {r["sector"]: r for r in sv.survival_upsert(old, new, t1).collect()}
    assert (got["A"]["avg_duration_days"], got["A"]["calculated_at"], got["A"]["updated_at"]) == (11.0, t0, t1)
    assert (got["B"]["sample_size"], got["B"]["updated_at"]) == (6, t0)          # absent from batch: kept
    assert (got["C"]["calculated_at"], got["C"]["updated_at"]) == (t1, t1)       # new key


def _site(spark, radius=500.0, sector=None, lat=37.5, lng=127.0):
    return spark.createDataFrame([(1, lat, lng, radius, sector)], SITE_SCHEMA)


def test_score_no_data(spark):
    s = _stores(spark, [(1, "a", "X", "", D(2000, 1, 1), None, 10.0, 10.0)])
    r = sc.survival_score(_site(spark), s, "2001-06-30").first()
    assert r["survival_score"] == 50.0 and r["recommendations"] == ["NO_DATA"] and r["competition_level"] == 0


def test_score_formula_and_codes(spark):
    # three open stores of two sectors ~100 m away, opened 4, 2 and 1 years before as_of
    as_of = D(2001, 6, 30)
    rows = [(1, "a", "X", "", D(1997, 6, 30), None, 37.5009, 127.0),
            (2, "b", "X", "", D(1999, 6, 30), None, 37.5, 127.0011),
            (3, "c", "Y", "", D(2000, 6, 30), None, 37.4991, 127.0)]
    r = sc.survival_score(_site(spark), _stores(spark, rows), as_of).first()
    days = [(as_of - x[4]).days for x in rows]
    avg = sum(days) / 3
    ratio = 1 / 3
    div = 2 / 3
    score = min(avg / 365 * 100, 100) * 0.4 + ratio * 100 * 0.3 + (100 - 3 / 20 * 100) * 0.2 + div * 100 * 0.1
    assert r["competition_level"] == 3
    assert r["avg_survival_days"] == math_round2(avg)
    assert r["survival_score"] == math_round2(score)
    assert r["long_term_ratio_pct"] == 33.33 and r["sector_diversity_pct"] == 66.67
    assert r["recommendations"] == ["GOOD"]


def math_round2(x):
    import math
    return math.floor(x * 100 + 0.5) / 100


def test_rating_bands_and_findings(spark):
    as_of = D(2001, 6, 30)
    rows = [(i, "n", "X", "", D(2001, 1, 1), None, 37.5 + i * 1e-5, 127.0) for i in range(25)]
    rows += [(100 + i, "n", "Y", "", D(1990, 1, 1), None, 37.5, 127.0 + i * 1e-5) for i in range(5)]
    r = sc.site_rating(_site(spark, sector="X"), _stores(spark, rows), as_of).first()
    assert r["same_sector_stores"] == 25 and r["competition_score"] == 20.0
    assert r["nearby_stores"] == 30 and r["accessibility_score"] == 100.0
    assert "FIERCE_COMPETITION" in r["recommendations"] and "OVER_COMPETITION" in r["risk_factors"]
    assert "ACTIVE_AREA" in r["opportunities"]
    f = sc.site_rating_findings(sc.site_rating(_site(spark, sector="X"), _stores(spark, rows), as_of))
    assert f.filter(F.col("message").isNull()).count() == 0
