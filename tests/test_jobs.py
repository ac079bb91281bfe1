"""File-to-CSV jobs, batch and streaming, on files written from the fixture."""

import tempfile

from pyspark.sql import functions as F

from eventclime.plans import jobs
from eventclime.plans.batch_queries import _fx
from eventclime.session import scratch_path
from eventclime.sources import writers
from eventclime.sources.sinks import read_result_csv, result_rows

from conftest import SF_SMALL


def _files(spark):
    fx = _fx(spark, SF_SMALL)
    ev = writers.write_lines(writers.event_lines(fx["events"]), scratch_path(spark, "t-ev"))
    wx = writers.write_lines(writers.weather_lines(fx["weather"]), scratch_path(spark, "t-wx"))
    st = writers.write_lines(writers.station_lines(fx["stations"]).coalesce(1), scratch_path(spark, "t-st"))
    return fx, ev, wx, st


def test_batch_jobs_write_csv(spark):
    fx, ev, wx, st = _files(spark)
    out = tempfile.mkdtemp(prefix="eventclime-out-")
    jobs.run_avg_job(spark, ev, wx, st, f"{out}/tone", after="2017-01-31")
    back = read_result_csv(spark, f"{out}/tone")
    expect = jobs.avg_by_weather_class(fx["events"], fx["weather"], fx["stations"])
    assert back.count() == expect.count() > 0
    assert back.first().window_start.endswith("T00:00:00Z")
    jobs.run_instability_job(spark, ev, f"{out}/inst")
    assert spark.read.csv(f"{out}/inst").count() == jobs.instability_index(fx["events"]).count()
    jobs.run_attention_job(spark, ev, f"{out}/att")
    assert spark.read.csv(f"{out}/att").count() == jobs.attention_share(fx["events"]).count()


def test_instability_stream_job(spark):
    fx, ev, _, _ = _files(spark)
    out = scratch_path(spark, "t-stream-out")
    q = jobs.start_instability_stream(spark, ev, out, scratch_path(spark, "t-stream-ckpt"))
    q.awaitTermination(600)
    got = spark.read.schema("window_start string, pct double").csv(out)
    assert got.count() == jobs.instability_index(fx["events"]).count()


def test_avg_stream_job_from_text_files(spark):
    fx, ev, wx, st = _files(spark)
    out = scratch_path(spark, "t-avg-stream-out")
    q = jobs.start_avg_stream(spark, ev, wx, st, out, scratch_path(spark, "t-avg-ckpt"))
    q.awaitTermination(900)
    got = read_result_csv(spark, out)
    ref = jobs.avg_by_weather_class(fx["events"], fx["weather"], fx["stations"])
    assert got.count() == ref.count() > 0
    a = sorted((r.window_start[:10], r.clz, round(r.value, 6)) for r in got.collect())
    b = sorted((r.window_start.date().isoformat(), r.clz, round(r.value, 6)) for r in ref.collect())
    assert a == b


def test_command_line_entry_point(spark):
    fx, ev, wx, st = _files(spark)
    out = tempfile.mkdtemp(prefix="eventclime-cli-")
    jobs.main(["avg-mentions", "--path", ev, "--wpath", wx, "--stations", st, "--out", f"{out}/m"])
    jobs.main(["instability", "--path", ev, "--out", f"{out}/i"])
    got = read_result_csv(spark, f"{out}/m")
    assert got.count() == jobs.avg_by_weather_class(
        fx["events"], fx["weather"], fx["stations"], value="numMentions").count() > 0
    assert spark.read.csv(f"{out}/i").count() == jobs.instability_index(fx["events"]).count()


def test_stream_job_over_several_batches_closes_its_input(spark):
    fx = _fx(spark, SF_SMALL)
    many = scratch_path(spark, "t-many")
    day = fx["events"].agg(F.percentile_approx("day", 0.5).alias("m")).first()["m"]
    # one file per batch, the later days in the later file
    for k, half in enumerate((F.col("day") < F.lit(day), F.col("day") >= F.lit(day))):
        writers.write_lines(writers.event_lines(fx["events"].where(half)).coalesce(1), f"{many}/{k}")
    out, ckpt = scratch_path(spark, "t-many-out"), scratch_path(spark, "t-many-ckpt")
    q = jobs.start_attention_stream(spark, f"{many}/*", out, ckpt, files_per_batch=1)
    q.awaitTermination()
    assert spark.read.csv(out).count() == jobs.attention_share(fx["events"]).count()


def test_open_stream_job_keeps_its_last_window(spark):
    fx, ev, _, _ = _files(spark)
    out = scratch_path(spark, "t-open-out")
    jobs.start_instability_stream(spark, ev, out, scratch_path(spark, "t-open-ckpt"), close=False).awaitTermination()
    assert spark.read.csv(out).count() == jobs.instability_index(fx["events"]).count() - 1


def test_csv_sink_gathers_by_an_exchange_and_keeps_all_columns(spark):
    rows = jobs.attention_share(_fx(spark, SF_SMALL)["events"]).selectExpr("*", "1 AS more")
    out = result_rows(rows)
    assert len(out.columns) == 4
    plan = out.repartition(1)._jdf.queryExecution().toString()
    assert "Exchange SinglePartition" in plan or "RoundRobinPartitioning(1)" in plan
