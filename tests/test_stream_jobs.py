"""Stream jobs over several runs: later files, late rows, damaged lines, one
published file, repeated micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventclime.operators import windows
from eventclime.plans import jobs
from eventclime.plans.batch_queries import _fx
from eventclime.session import scratch_path
from eventclime.sources import files, sinks, text, writers
from eventclime.streaming import ingest
from eventclime.streaming import pipeline as P

from conftest import SF_SMALL

COLUMNS = "globalEventID long, day date, quadClass int, eventRootCode string, eventGeo_countryCode string"


def _day(n):
    return dt.date(2017, 3, 1) + dt.timedelta(days=n)


def _arrive(spark, folder, rows):
    """Events (day number, quad class) come as a file of lines."""
    df = spark.createDataFrame([(k, None if d is None else _day(d), q, "01", "US") for k, (d, q) in enumerate(rows)], COLUMNS)
    writers.event_lines(df).coalesce(1).write.mode("append").text(folder)


def _published(spark, out):
    names = [n for n in files.names(spark, out) if n.startswith("part-")]
    assert len(names) == 1
    return {r.window_start[:10]: r.v for r in spark.read.schema("window_start string, v double").csv(out).collect()}


def test_a_second_run_goes_on_where_the_first_one_stopped(spark):
    folder, out, ckpt = (scratch_path(spark, f"t-{n}") for n in ("two-runs", "two-out", "two-ckpt"))
    run = lambda: jobs.start_instability_stream(spark, folder, out, ckpt)
    _arrive(spark, folder, [(0, 4), (0, 1), (1, 4), (2, 4)])
    job = run()
    assert _published(spark, out) == {"2017-03-01": 50.0, "2017-03-02": 100.0, "2017-03-03": 100.0}
    # the last day goes on, three more follow
    _arrive(spark, folder, [(2, 1), (2, 1), (2, 1), (3, 4), (4, 4), (5, 4), (5, 1)])
    job = run()
    want = {"2017-03-01": 50.0, "2017-03-02": 100.0, "2017-03-03": 25.0, "2017-03-04": 100.0, "2017-03-05": 100.0, "2017-03-06": 50.0}
    assert _published(spark, out) == want
    # nothing new: the same file; rows behind the watermark are set aside, not lost
    run()
    assert _published(spark, out) == want
    _arrive(spark, folder, [(0, 1), (0, 4), (5, 1), (5, 1)])
    job = run()
    assert _published(spark, out) == want | {"2017-03-06": 25.0}
    assert [r.day for r in job.late().collect()] == [_day(0)] * 2
    log = job.log().orderBy("batch").collect()
    assert [(r.good, r.late, r.rejected) for r in log] == [(4, 0, 0), (7, 0, 0), (2, 2, 0)]
    assert [r.watermark.date() for r in log[1:]] == [_day(2), _day(5)]
    # no row that the ingest let through was dropped by the analysis
    assert all(op["numRowsDroppedByWatermark"] == 0 for q in job.queries for p in q.recentProgress for op in p["stateOperators"])


def test_a_delay_keeps_windows_open(spark):
    folder, out, ckpt = (scratch_path(spark, f"t-{n}") for n in ("delay", "delay-out", "delay-ckpt"))
    for rows in ([(0, 4), (3, 4)], [(1, 4), (0, 4)], [(2, 4)]):
        _arrive(spark, folder, rows)
        job = jobs.start_count_stream(spark, folder, out, ckpt, delay="2 days")
    # after day 3 the watermark is day 1, so only day 0 has ended
    assert [r.day for r in job.late().collect()] == [_day(0)]
    assert _published(spark, out) == {f"2017-03-0{d + 1}": 1.0 for d in range(4)}


def test_damaged_lines_of_a_stream_are_kept_with_their_reason(spark):
    events = _fx(spark, SF_SMALL)["events"]
    folder, out, ckpt = (scratch_path(spark, f"t-{n}") for n in ("bad", "bad-out", "bad-ckpt"))
    writers.event_lines(events.where("globalEventID % 2 = 0")).coalesce(1).write.mode("append").text(folder)
    jobs.start_instability_stream(spark, folder, out, ckpt)
    writers.dirty_event_lines(events.where("globalEventID % 2 = 1")).coalesce(1).write.mode("append").text(folder)
    job = jobs.start_instability_stream(spark, folder, out, ckpt, delay="1000 days")
    want = text.read_event_rejects(spark, folder)
    got = job.rejects().drop("batch")
    assert want.count() > 10 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    log = job.log().agg(F.sum("good"), F.sum("late"), F.sum("rejected")).first()
    assert sum(log) == spark.read.text(folder).count() and log[2] == want.count()


def test_two_inputs_set_nothing_aside_as_late(spark):
    """The slower watermark decides there."""
    fx = _fx(spark, SF_SMALL)
    ev, wx = scratch_path(spark, "t-two-ev"), scratch_path(spark, "t-two-wx")
    st = writers.write_lines(writers.station_lines(fx["stations"]).coalesce(1), scratch_path(spark, "t-two-st"))
    out, ckpt = scratch_path(spark, "t-two-out"), scratch_path(spark, "t-two-ckpt")
    mid = fx["events"].agg(F.percentile_approx("day", 0.5)).first()[0]
    for early in (True, False):     # weather and events of the first half, then of the second
        part = lambda c: (F.col(c) <= F.lit(mid)) == F.lit(early)  # noqa: B023, E731
        writers.event_lines(fx["events"].where(part("day"))).write.mode("append").text(ev)
        writers.weather_lines(fx["weather"].where(part("date"))).write.mode("append").text(wx)
        job = jobs.start_avg_stream(spark, ev, wx, st, out, ckpt)
    assert job.late("events").isEmpty() and job.late("weather").isEmpty()
    ref = jobs.avg_by_weather_class(fx["events"], fx["weather"], fx["stations"])
    a = sorted((r.window_start, r.clz, round(r.value, 6)) for r in job.result().collect())
    assert a == sorted((r.window_start, r.clz, round(r.value, 6)) for r in ref.collect()) and len(a) > 2


def test_state_has_the_asked_partitions(spark):
    folder = scratch_path(spark, "t-parts")
    _arrive(spark, folder, [(0, 4), (1, 4)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        for asked, want in ((None, 6), (3, 3)):
            ckpt = scratch_path(spark, "t-parts-ckpt")
            jobs.start_count_stream(spark, folder, scratch_path(spark, "t-parts-out"), ckpt, state_partitions=asked)
            offsets = spark.read.text(f"{ckpt}/analysis/offsets/0").collect()
            assert any(f'"spark.sql.shuffle.partitions":"{want}"' in r.value for r in offsets)
            assert spark.conf.get("spark.sql.shuffle.partitions") == "6"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_repeated_micro_batch_doubles_nothing(spark, monkeypatch):
    monkeypatch.setattr(sinks, "FOLD", 3)
    folder, out = scratch_path(spark, "t-result"), scratch_path(spark, "t-published")
    rows = lambda *days: spark.createDataFrame([(dt.datetime(2017, 3, d), float(d)) for d in days], "window_start timestamp, v double")
    for k in range(8):
        sinks.add_batch(rows(k + 1), k, folder)
        sinks.add_batch(rows(k + 1), k, folder)         # tried again
    sinks.set_open(rows(20, 21), folder)
    sinks.set_open(rows(20), folder)
    schema = rows(1).schema
    sinks.publish(spark, schema, folder, out)
    want = {f"2017-03-{d:02d}": float(d) for d in [*range(1, 9), 20]}
    assert _published(spark, out) == want
    assert len([n for n in files.names(spark, folder) if n.startswith("batch=")]) < 4
    sinks.publish(spark, schema, folder, out)
    assert _published(spark, out) == want
    assert sinks.held_result(spark, schema, scratch_path(spark, "t-none")).count() == 0


def test_a_repeated_ingest_batch_is_not_written_again(spark):
    folder = scratch_path(spark, "t-ingest")
    lines = writers.event_lines(_fx(spark, SF_SMALL)["events"].limit(50))
    parsed = text.parse_event_lines(lines)
    split = lambda k: ingest.split_batch(parsed, k, folder, ["day"], "day", ("1 day", None), "0 seconds")
    split(0), split(0)
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/rows").count() == 50
    # a try that ended before its rows appeared: the log is there, the rows come now
    files.move(spark, f"{folder}/rows/batch-0", f"{folder}/lost")
    split(0)
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/rows").count() == 50
    assert ingest.ingest_log(spark, folder).count() == 1


@pytest.mark.parametrize("size, slide, want", [("1 day", None, "2017-03-03"), ("2 days", None, "2017-03-04"), ("4 days", "2 days", "2017-03-06"), ("3 days", "1 day", "2017-03-05")])
def test_last_window_end_is_that_of_the_window_function(spark, size, slide, want):
    df = spark.createDataFrame([(dt.datetime(2017, 3, 2, 5),), (None,)], "t timestamp")
    got = [r[0] for r in df.select(F.timestamp_seconds(ingest.last_window_end(F.col("t"), size, slide))).collect()]
    last = df.select(F.window("t", size, slide or size).alias("w")).agg(F.max("w.end")).first()[0]
    assert got == [last, None]


def test_an_ongoing_job_publishes_after_every_batch(spark):
    folder, out, ckpt = (scratch_path(spark, f"t-{n}") for n in ("on", "on-out", "on-ckpt"))
    _arrive(spark, folder, [(0, 4), (1, 4), (2, 1)])
    job = jobs.start_count_stream(spark, folder, out, ckpt, trigger={"processingTime": "1 second"})
    try:
        for q in job.queries:
            q.processAllAvailable()
        job.queries[-1].processAllAvailable()
        assert _published(spark, out) == {"2017-03-01": 1.0, "2017-03-02": 1.0}
        _arrive(spark, folder, [(2, 1), (0, 4), (3, 1)])
        for q in job.queries:
            q.processAllAvailable()
        job.queries[-1].processAllAvailable()
        assert _published(spark, out) == {"2017-03-01": 1.0, "2017-03-02": 1.0, "2017-03-03": 2.0}
        assert job.late().count() == 1
    finally:
        job.stop()
