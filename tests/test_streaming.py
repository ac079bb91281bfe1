"""Streaming behaviour beyond the registered single-feed queries."""

from pyspark.sql import functions as F

from eventclime.operators import filters, windows
from eventclime.operators.windows import EVENT_TS, with_event_time
from eventclime.plans import batch_queries as B
from eventclime.plans import stream_queries as S
from eventclime.session import scratch_path
from eventclime.streaming import pipeline as P

from conftest import SF_SMALL


def _phased(spark, df, day_col, folder, first, span, files, phases=3):
    for p in range(phases):
        ph = F.least(F.floor(F.datediff(F.col(day_col), F.lit(first)) * phases / F.lit(span)), F.lit(phases - 1))
        df.where(ph == p).repartition(files).write.mode("append").parquet(folder)


def test_avg_stream_over_many_batches_equals_batch(spark):
    fx = B._fx(spark, SF_SMALL)
    usc = fx["stations"].where(filters.station_prefix())
    grid = P.station_lookup_grid(spark, usc)
    ev, wx = fx["events"], fx["weather"]
    ev_s, wx_s = P.event_sentinel(ev), P.reading_sentinel(wx)
    first = ev.agg(F.min("day")).scalar()
    span = ev.agg(F.datediff(F.max("day"), F.min("day")) + F.lit(1)).scalar()
    evdir, wxdir = scratch_path(spark, "t-mb-ev"), scratch_path(spark, "t-mb-wx")
    _phased(spark, ev, "day", evdir, first, span, 2)
    _phased(spark, wx, "date", wxdir, first, span, 2)
    ev_s.write.mode("append").parquet(evdir)
    wx_s.write.mode("append").parquet(wxdir)
    es = P.with_watermark(with_event_time(P.stream_parquet(spark, evdir, ev.schema, files_per_batch=2)), EVENT_TS)
    ws = P.stream_parquet(spark, wxdir, wx.schema, files_per_batch=2)
    readings = P.with_watermark(P.weather_stream_readings(ws), P.WEATHER_TS)
    res = P.stream_avg_by_weather_class(P.located_event_stream(es, grid), readings, "avgTone")
    out = B._present(P.run_to_table(spark, res, "t-mb"))
    assert P.LAST_RUN["t-mb"]["batches"] >= 4
    ref = B.q_avg_tone_by_temp(spark, SF_SMALL)
    assert out.count() == ref.count() > 0
    assert out.exceptAll(ref).count() == 0 and ref.exceptAll(out).count() == 0


def test_without_sentinel_last_window_stays_open(spark):
    fx = B._fx(spark, SF_SMALL)
    folder = scratch_path(spark, "t-nosent")
    fx["events"].write.parquet(folder)
    stream = P.stream_parquet(spark, folder, fx["events"].schema)
    res = windows.count_all(P.with_watermark(with_event_time(stream), EVENT_TS), "1 day")
    got = P.run_to_table(spark, res, "t-nosent").count()
    assert got == windows.count_all(fx["events"], "1 day").count() - 1


def _folder_table(spark, tmp_path, extra=None):
    """sf0.001 with the events table as a folder of three part files."""
    d = str(tmp_path)
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    if extra is not None:
        ev = ev.unionByName(extra(ev))
    ev.repartition(3).write.parquet(f"{d}/events.parquet")
    spark.read.parquet(f"{SF_SMALL}/supplier.parquet").write.parquet(f"{d}/supplier.parquet")
    return d


def _equal(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    d = _folder_table(spark, tmp_path)
    ref = B.q_count_all_1d(spark, SF_SMALL)
    assert ref.count() > 1
    assert _equal(S.q_stream_count_all_1d(spark, d), ref)
    assert _equal(S.q_stream_instability_index(spark, d), B.q_instability_index(spark, SF_SMALL))
    assert _equal(S.q_stream_attention_share(spark, d), B.q_attention_share(spark, SF_SMALL))


def test_streams_keep_events_of_far_years(spark, tmp_path):
    d = _folder_table(spark, tmp_path, lambda ev: ev.orderBy("event_id").limit(1).withColumn("ts", F.lit("9999-12-31 05:00:00").cast(ev.schema["ts"].dataType)))
    got = S.q_stream_count_all_1d(spark, d)
    assert got.where("window_start like '9999-12-31%'").count() == 1
    assert _equal(got, B.q_count_all_1d(spark, d))


def test_salted_row_join_with_a_hot_station_day(spark):
    ev = spark.range(900).select(
        F.col("id").alias("globalEventID"), F.col("id").cast("double").alias("avgTone"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("station_id"),
        F.lit("2017-03-01").cast("timestamp").alias(EVENT_TS))
    rd = ev.select(F.col("station_id").alias("id"), F.lit(1.0).alias("temp"), F.col(EVENT_TS).alias(P.WEATHER_TS)).distinct()
    evdir, rddir = scratch_path(spark, "t-hot-ev"), scratch_path(spark, "t-hot-rd")
    ev.repartition(4).write.parquet(evdir), rd.write.parquet(rddir)
    es = P.with_watermark(P.stream_parquet(spark, evdir, ev.schema, files_per_batch=1), EVENT_TS)
    rs = P.with_watermark(P.stream_parquet(spark, rddir, rd.schema), P.WEATHER_TS)
    got = P.run_to_table(spark, P.stream_event_weather(es, rs), "t-hot")
    assert got.count() == 900 and got.select("globalEventID").distinct().count() == 900


def _state_rows(spark, monkeypatch, joined, name):
    """Rows that the join has put into its state in the whole run, and the result."""
    monkeypatch.setattr(P, "_summary", lambda progress: sum(op["numRowsUpdated"] for p in progress for op in p["stateOperators"]))
    got = P.run_to_table(spark, joined, name)
    return P.LAST_RUN.pop(name), got


def test_copies_of_a_reading_follow_the_state_partitions(spark, monkeypatch):
    """A bounded run has one state partition per core (4), whatever the
    session's shuffle setting: more copies would only fill the state."""
    ev = spark.range(60).select(
        F.col("id").alias("globalEventID"), F.col("id").cast("double").alias("avgTone"),
        F.concat(F.lit("s"), F.col("id") % 20).alias("station_id"), F.lit("2017-03-01").cast("timestamp").alias(EVENT_TS))
    rd = spark.range(50).select(F.concat(F.lit("s"), F.col("id")).alias("id"), F.lit(1.0).alias("temp"), F.lit("2017-03-01").cast("timestamp").alias(P.WEATHER_TS))
    evdir, rddir = scratch_path(spark, "t-copies-ev"), scratch_path(spark, "t-copies-rd")
    ev.write.parquet(evdir), rd.write.parquet(rddir)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        es = P.with_watermark(P.stream_parquet(spark, evdir, ev.schema), EVENT_TS)
        rs = P.with_watermark(P.stream_parquet(spark, rddir, rd.schema), P.WEATHER_TS)
        kept, got = _state_rows(spark, monkeypatch, P.stream_event_weather(es, rs), "t-copies")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert kept == 60 + 2 * 50
    assert got.count() == 60


def test_row_join_keeps_only_readings_that_an_event_can_meet(spark, tmp_path, monkeypatch):
    """Readings of other stations (prefix, or a second station at a place) are
    not kept; the sentinel still ends the last day, and no row is lost."""
    d = str(tmp_path)
    spark.range(1, 61).selectExpr("id event_id", "timestamp_ntz'2024-01-01 05:00:00' + make_interval(0, 0, 0, cast(id % 3 as int)) ts",
                                  "id % 11 user_id", "'x' event_type", "cast(id as double) value", "'' props").write.parquet(f"{d}/events.parquet")
    keys = [*range(1, 13), 1 + 15960]       # the last one is where the first one is
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{d}/supplier.parquet")
    fx = B._fx(spark, d)
    located, readings = S._weather_inputs(spark, d, of_grid=True)
    kept, _ = _state_rows(spark, monkeypatch, P.stream_event_weather(located, readings, salt=2), "t-met")
    named = [f"USC{k:08d}" for k in keys[:12] if k % 4]
    can_meet = fx["weather"].where(F.col("id").isin(named) & (F.col("element") == "TMAX"))
    n_located = B.q_nearest_station(spark, d).count()
    assert can_meet.count() < fx["weather"].where("element = 'TMAX'").count()
    assert kept == n_located + 1 + 2 * can_meet.count()      # one sentinel event
    got, ref = S.q_stream_event_weather_join(spark, d), B.q_event_weather_join(spark, d)
    assert ref.count() > 10 and ref.select("day").distinct().count() == 3
    assert _equal(got, ref)


def test_row_join_computes_distances_once(spark):
    """And an event without a station meets no reading without one."""
    fx = B._fx(spark, SF_SMALL)
    grid = P.station_lookup_grid(spark, fx["stations"].where(filters.station_prefix()))
    located = P.located_event_stream(with_event_time(fx["events"]), grid)
    joined = P.stream_event_weather(located, P.weather_stream_readings(fx["weather"]))
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("array_min(") == 1
    at = F.lit("2017-03-01").cast("timestamp")
    ev = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, None), (3, 3.0, "")], "globalEventID long, avgTone double, station_id string").withColumn(EVENT_TS, at)
    rd = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", 3.0)], "id string, temp double").withColumn(P.WEATHER_TS, at)
    assert [r.globalEventID for r in P.stream_event_weather(ev, rd).collect()] == [1]
