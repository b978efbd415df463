"""Opening snapshots of every grain against a plain ranking; far years cost nothing."""

import datetime as dt

import pytest

from sitelens.operators import stores as so

D = dt.date


def rows():
    out = [(i, "AB"[i % 2] if i % 7 else (None if i % 2 else ""), D(2020, 1, 1) + dt.timedelta(days=(i * 37) % 40)) for i in range(60)]
    out += [(100 + i, "C", D(2020, 1, 20)) for i in range(40)]  # one day holds a third
    return out + [(200, "D", D(2020, 4, 2)), (201, "D", None), (202, "E", D(9999, 12, 31))]


def brute(stores, n, grain):
    dated = [s for s in stores if s[2] is not None]
    first, last = min(s[2] for s in dated), max(s[2] for s in dated)
    ends, day = set(), first
    while day <= last or grain != "day":
        end = {"day": day, "week": day + dt.timedelta(days=6 - day.weekday()),
               "month": (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)}[grain]
        ends.add(end)
        if end >= last:
            break
        day = end + dt.timedelta(days=1)
    out = []
    for end in sorted(ends):
        top = sorted((s for s in dated if s[2] <= end), key=lambda s: (-s[2].toordinal(), s[0]))[:n]
        out.append((end, len(top), top[0][2], list(dict.fromkeys(s[1] for s in top if s[1]))))
    return out


@pytest.mark.parametrize("grain", so.GRAINS)
@pytest.mark.parametrize("n", [1, 7, 50])
def test_grains(spark, grain, n):
    known = rows()[:-1]
    df = spark.createDataFrame(rows(), "id long, sector string, open_date date").repartition(3)
    got = [(r.snapshot_date, r.sample_size, r.latest_opened_at, r.sectors)
           for r in so.opening_snapshots(df, n, until="2020-12-31", grain=grain).orderBy("snapshot_date").collect()]
    assert got == brute(known, n, grain)


def test_unknown_grain_and_no_openings(spark):
    df = spark.createDataFrame([(1, "A", None)], "id long, sector string, open_date date")
    assert so.opening_snapshots(df, 5, grain="day").collect() == []
    with pytest.raises(ValueError):
        so.opening_snapshots(df, 5, grain="year")
