"""Hand-computed fixture: seven events, three stations, five readings."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from eventclime.functions.timefmt import render_instant
from eventclime.operators import aggregates, windows
from eventclime.operators.nearest import nearest_station

D = dt.date


@pytest.fixture(scope="module")
def golden(spark):
    ev = spark.createDataFrame(
        [
            (1, D(2017, 2, 1), "USA", True, "01", 1, 10, 2.0, "US", 39.9, -100.1),
            (2, D(2017, 2, 1), "USA", True, "19", 4, 4, -1.0, "US", 30.1, -90.1),
            (3, D(2017, 2, 1), "USA", True, "14", 3, 20, 4.0, "UK", 39.8, -100.0),
            (4, D(2017, 2, 2), "USA", True, "05", 2, 6, 1.0, "FR", 35.0, -95.0),
            (5, D(2017, 2, 2), "GBR", True, "18", 4, 100, 9.0, "UK", 40.0, -100.0),
            (6, D(2017, 2, 2), "USA", False, None, None, 1, 0.0, None, 40.0, -100.0),
            (7, D(2017, 2, 3), "USA", True, "14", 1, 2, 0.5, "US", None, -100.0),
        ],
        "globalEventID long, day date, actor1Code_countryCode string, isRoot boolean, eventRootCode string,"
        " quadClass int, numMentions int, avgTone double, eventGeo_countryCode string,"
        " eventGeo_lat double, eventGeo_long double",
    )
    st = spark.createDataFrame(
        [("USC00000001", 40.0, -100.0, 1), ("USC00000002", 30.0, -90.0, 2), ("USW00000003", 35.0, -95.0, 3)],
        "id string, latitude double, longitude double, ord long",
    )
    wx = spark.createDataFrame(
        [
            ("USC00000001", D(2017, 1, 31), "TMAX", "100"),
            ("USC00000001", D(2017, 2, 1), "TMAX", "33"),
            ("USC00000001", D(2017, 2, 1), "TMIN", "-10"),
            ("USC00000002", D(2017, 2, 1), "TMAX", "250"),
            ("USC00000001", D(2017, 2, 2), "TMAX", "50"),
        ],
        "id string, date date, element string, datavalue string",
    )
    return ev, wx, st


def _rows(df, *cols):
    out = df.select(render_instant(F.col("window_start")).alias("w"), *cols).collect()
    return sorted((r["w"][:10], *[round(r[c], 2) if isinstance(r[c], float) else r[c] for c in cols]) for r in out)


def test_nearest(golden):
    ev, _, st = golden
    got = nearest_station(ev, st.where(F.col("id").startswith("USC")))
    m = {r.globalEventID: r.station_id for r in got.collect()}
    assert m[1] == m[3] == m[4] == m[5] == m[6] == "USC00000001"
    assert m[2] == "USC00000002"
    assert 7 not in m  # null latitude


def test_avg_mentions(golden):
    ev, wx, st = golden
    res = aggregates.avg_by_weather_class(ev, wx, st, value="numMentions")
    assert _rows(res, "clz", "value") == [
        ("2017-02-01", "high", 4.0), ("2017-02-01", "low", 15.0), ("2017-02-02", "mid", 6.0)
    ]


def test_avg_tone(golden):
    ev, wx, st = golden
    res = aggregates.avg_by_weather_class(ev, wx, st, value="avgTone")
    assert _rows(res, "clz", "value") == [
        ("2017-02-01", "high", -1.0), ("2017-02-01", "low", 3.0), ("2017-02-02", "mid", 1.0)
    ]


def test_instability(golden):
    ev, _, _ = golden
    assert _rows(windows.instability_index(ev), "pct") == [
        ("2017-02-01", 66.67), ("2017-02-02", 33.33), ("2017-02-03", 100.0)
    ]


def test_attention_two_days(golden):
    ev, _, _ = golden
    assert _rows(windows.attention_share(ev), "country", "pct") == [
        ("2017-02-01", "FR", 16.67), ("2017-02-01", "UK", 33.33), ("2017-02-01", "US", 33.33),
        ("2017-02-03", "US", 100.0),
    ]


def test_pivot(golden):
    ev, wx, st = golden
    res = aggregates.series_pivot(aggregates.avg_by_weather_class(ev, wx, st, value="numMentions"))
    rows = {r.window_start.date().isoformat(): (r.low, r.mid, r.high) for r in res.collect()}
    assert rows == {"2017-02-01": (15.0, None, 4.0), "2017-02-02": (None, 6.0, None)}


def test_sliding_windows_cover_each_day_twice(golden):
    ev, wx, st = golden
    res = aggregates.avg_by_weather_class(ev, wx, st, value="numMentions", size="4 days", slide="2 days")
    starts = sorted({r.window_start.date().isoformat() for r in res.collect()})
    assert starts == ["2017-01-30", "2017-02-01"]


def test_class_boundaries(spark):
    from eventclime.functions.classify import classify

    df = spark.createDataFrame([(4.9,), (5.0,), (24.9,), (25.0,), (float("nan"),), (None,)], "t double")
    got = [r.c for r in df.select(classify(F.col("t")).alias("c")).collect()]
    assert got == ["low", "mid", "mid", "high", None, None]


def test_duplicate_readings_keep_bag_semantics(spark):
    """Pre-aggregated plan == naive row-level join + avg, with copies."""
    from conftest import SF_SMALL
    from eventclime.operators import weather as W
    from eventclime.plans.batch_queries import _fx

    fx = _fx(spark, SF_SMALL)
    wx = fx["weather"]
    wx = wx.unionByName(wx.where(F.dayofmonth("date") % 3 == 0))  # copies on every third day
    got = aggregates.avg_by_weather_class(fx["events"], wx, fx["stations"], value="avgTone")
    naive = (
        W.classify_temperature(W.event_weather_join(fx["events"], wx, fx["stations"]))
        .groupBy(F.window(F.col("day").cast("timestamp"), "1 day").alias("w"), "clz")
        .agg(F.avg("value").alias("value"))
        .select(F.col("w.start").alias("window_start"), "clz", "value")
    )
    a = {(r.window_start, r.clz): round(r.value, 9) for r in got.collect()}
    b = {(r.window_start, r.clz): round(r.value, 9) for r in naive.collect()}
    assert a == b and len(a) > 0


def test_max_km_drops_far_events(golden):
    ev, _, st = golden
    usc = st.where(F.col("id").startswith("USC"))
    near = {r.globalEventID for r in nearest_station(ev, usc, max_km=25.0).collect()}
    assert near == {1, 2, 3, 5, 6}   # 3 is 22 km from A; 4 is ~700 km away


def test_averages_do_not_depend_on_order(spark, golden):
    """Doubles whose plain sum depends on their order: any order, partitions and runs give the same bits."""
    _, wx, st = golden
    tones = [0.1 * k - 7.3 + 1e-7 * (k % 13) for k in range(3000)] + [1e6 / 3, -1e6 / 3]
    rows = [(k, D(2017, 2, 1), "USA", True, 1, t, 39.9 + k % 7 / 100, -100.1) for k, t in enumerate(tones)]
    schema = "globalEventID long, day date, actor1Code_countryCode string, isRoot boolean, numMentions int, avgTone double, eventGeo_lat double, eventGeo_long double"
    got = set()
    for seed in range(3):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        ev = spark.createDataFrame(shuffled, schema).repartition(seed + 1)
        got |= {(r.clz, r.value) for r in aggregates.avg_by_weather_class(ev, wx, st).collect()}
    assert len(got) == 1 and next(iter(got))[1] == pytest.approx(math.fsum(tones) / len(tones), abs=1e-12)
    # what is no number, or too large for whole parts, still counts as a double
    for odd, want in ((float("nan"), math.nan), (float("inf"), math.inf), (4e7, (4e7 + math.fsum(tones)) / (len(tones) + 1))):
        ev = spark.createDataFrame([*rows, (9999, D(2017, 2, 1), "USA", True, 1, odd, 39.9, -100.1)], schema)
        assert aggregates.avg_by_weather_class(ev, wx, st).first().value == pytest.approx(want, nan_ok=True)
