"""Registered streaming queries: each runs a Structured Streaming query over
files derived from the driver's tables to completion and returns its sink as
a batch DataFrame.  With the sentinel rows, the append-mode result equals the
batch result, so the batch oracle SQL applies unchanged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, windows
from ..operators.windows import EVENT_TS, with_event_time
from ..session import prepare, scratch_path
from ..sources import text, writers
from ..sources.fixtures import fx_event, oracle_with, read_table
from ..streaming import pipeline as P
from . import batch_queries as B
from . import jobs
from .file_queries import _event_out, write_event_files


def _event_stream(spark, sf_dir):
    """The driver's events table (a file or a folder) read as a stream,
    derived like the batch view."""
    schema = read_table(spark, sf_dir, "events").schema
    return fx_event(P.stream_table(spark, f"{sf_dir.rstrip('/')}/events.parquet", schema))


def _closed_event_stream(spark, sf_dir):
    """Event stream plus its sentinel, watermarked on event time."""
    prepare(spark)
    ev = _event_stream(spark, sf_dir)
    sent = P.write_sentinel(spark, P.event_sentinel(ev), "event-sentinel")
    sent_stream = P.stream_parquet(spark, sent, ev.schema)
    return P.with_watermark(with_event_time(ev.unionByName(sent_stream)), EVENT_TS)


def q_stream_scan_events(spark, sf_dir):
    path = write_event_files(spark, sf_dir)
    parsed = text.valid_rows(text.parse_event_lines(P.stream_text(spark, path)))
    return _event_out(P.run_to_table(spark, parsed, "stream-scan-events"))


def q_stream_count_all_1d(spark, sf_dir):
    res = windows.count_all(_closed_event_stream(spark, sf_dir), "1 day")
    return B._present(P.run_to_table(spark, res, "stream-count-all-1d"))


def q_stream_instability_index(spark, sf_dir):
    res = windows.instability_index(_closed_event_stream(spark, sf_dir))
    return B._present(P.run_to_table(spark, res, "stream-instability"))


def q_stream_attention_share(spark, sf_dir):
    res = windows.attention_share(_closed_event_stream(spark, sf_dir))
    return B._present(P.run_to_table(spark, res, "stream-attention"))


def _weather_inputs(spark, sf_dir, extra_filter=None, as_text=False, of_grid=False):
    """Watermarked located-event stream and reading stream, both closed by
    sentinels; ``as_text`` streams the readings from weather CSV files, and
    ``of_grid`` leaves out those that no located event can meet."""
    fx = B._fx(spark, sf_dir)
    grid = P.station_lookup_grid(spark, fx["stations"].where(filters.station_prefix()))
    located = P.located_event_stream(_closed_event_stream(spark, sf_dir), grid, extra_filter=extra_filter)

    wx_path = scratch_path(spark, "weather-stream")
    if as_text:
        writers.write_lines(writers.weather_lines(fx["weather"]), wx_path)
        wx = text.valid_rows(text.parse_weather_lines(P.stream_text(spark, wx_path)))
    else:
        fx["weather"].write.parquet(wx_path)
        wx = P.stream_parquet(spark, wx_path, fx["weather"].schema)
    wx_sent = P.write_sentinel(spark, P.reading_sentinel(wx), "weather-sentinel")
    wx = wx.unionByName(P.stream_parquet(spark, wx_sent, wx.schema))
    readings = P.with_watermark(P.weather_stream_readings(wx), P.WEATHER_TS)
    return located, P.readings_of_grid(readings, grid) if of_grid else readings


def q_stream_event_weather_join(spark, sf_dir):
    located, readings = _weather_inputs(spark, sf_dir, of_grid=True)
    joined = P.stream_event_weather(located, readings, "avgTone")
    out = joined.select("globalEventID", F.col("ew.start").alias("day_ts"), "value", "temp")
    return P.run_to_table(spark, out, "stream-event-weather").select(
        "globalEventID", F.date_format("day_ts", "yyyy-MM-dd").alias("day"),
        F.round("value", 6).alias("value"), "temp",
    )


def _stream_avg(spark, sf_dir, value, size="1 day", slide=None, **inputs):
    located, readings = _weather_inputs(spark, sf_dir, **inputs)
    res = P.stream_avg_by_weather_class(located, readings, value, size=size, slide=slide)
    return B._present(P.run_to_table(spark, res, f"stream-avg-{value}"))


def q_stream_avg_tone_by_temp(spark, sf_dir):
    return _stream_avg(spark, sf_dir, "avgTone")


def q_stream_avg_mentions_by_temp(spark, sf_dir):
    """The readings come from weather CSV files."""
    return _stream_avg(spark, sf_dir, "numMentions", as_text=True)


def q_stream_avg_tone_sliding(spark, sf_dir):
    return _stream_avg(spark, sf_dir, "avgTone", size="4 days", slide="2 days")


def q_stream_avg_mentions_sliding(spark, sf_dir):
    return _stream_avg(spark, sf_dir, "numMentions", size="4 days", slide="2 days")


def q_stream_avg_tone_riots(spark, sf_dir):
    return _stream_avg(spark, sf_dir, "avgTone", extra_filter=filters.riot_event())


def q_stream_sink_csv(spark, sf_dir):
    """The instability job over event files: its published CSV file, read back."""
    events = write_event_files(spark, sf_dir)
    out, ckpt = scratch_path(spark, "stream-csv"), scratch_path(spark, "stream-csv-ckpt")
    jobs.start_instability_stream(spark, events, out, ckpt, state_partitions=P.bounded_partitions(spark))
    back = spark.read.schema("window_start string, pct double").csv(out)
    return back.select("window_start", F.round("pct", 6).alias("pct"))


def q_stream_ingest_rejects(spark, sf_dir):
    """What the instability job sets aside of damaged event files."""
    events = write_event_files(spark, sf_dir, dirty=True)
    job = jobs.start_instability_stream(spark, events, scratch_path(spark, "rejects-csv"), scratch_path(spark, "rejects-ckpt"),
                                        state_partitions=P.bounded_partitions(spark))
    return job.rejects().select(F.split(F.col("line"), "\t", 2).getItem(0).alias("event_token"), "n_tokens", "reason")


def q_stream_late_drop(spark, sf_dir):
    """Events arrive in day order over three runs of one job, then copies of
    the first days arrive a run late.  They are behind the watermark: the
    daily counts equal those of the original events, and ``late`` is how many
    rows of the day were set aside."""
    ev = B._fx(spark, sf_dir)["events"]
    folder, ckpt = scratch_path(spark, "late-events"), scratch_path(spark, "late-ckpt")
    first, span = ev.agg(F.min("day"), F.datediff(F.max("day"), F.min("day")) + F.lit(1)).first()
    offset = F.datediff(F.col("day"), F.lit(first))
    phase = F.least(F.floor(offset * 3 / span), F.lit(2))
    arrivals = [*[ev.where(phase == p) for p in range(3)], ev.where(offset * 6 < span)]
    for n, rows in enumerate(arrivals, 1):    # the windows are asked for at the end only
        writers.event_lines(rows).write.mode("append").text(folder)
        job = jobs.start_count_stream(spark, folder, scratch_path(spark, "late-csv"), ckpt,
                                      close=n == len(arrivals), state_partitions=P.bounded_partitions(spark))
    late = windows.count_all(job.late(), "1 day").withColumnRenamed("n", "late")
    return B._present(job.result().join(late, "window_start", "left").select(
        "window_start", "n", F.coalesce("late", F.lit(0)).cast("long").alias("late")))


QUERIES = {
    "stream_scan_events": q_stream_scan_events,
    "stream_count_all_1d": q_stream_count_all_1d,
    "stream_instability_index": q_stream_instability_index,
    "stream_attention_share": q_stream_attention_share,
    "stream_event_weather_join": q_stream_event_weather_join,
    "stream_avg_tone_by_temp": q_stream_avg_tone_by_temp,
    "stream_avg_mentions_by_temp": q_stream_avg_mentions_by_temp,
    "stream_avg_tone_sliding": q_stream_avg_tone_sliding,
    "stream_avg_mentions_sliding": q_stream_avg_mentions_sliding,
    "stream_avg_tone_riots": q_stream_avg_tone_riots,
    "stream_sink_csv": q_stream_sink_csv,
    "stream_ingest_rejects": q_stream_ingest_rejects,
    "stream_late_drop": q_stream_late_drop,
}


def _same_as(batch_key: str) -> str:
    return B.ORACLE_SQL[batch_key]


def oracle() -> dict[str, str]:
    from .file_queries import ORACLE_SQL as FILE_SQL

    return {
        "stream_scan_events": FILE_SQL["scan_events"],
        "stream_count_all_1d": _same_as("count_all_1d"),
        "stream_instability_index": _same_as("instability_index"),
        "stream_attention_share": _same_as("attention_share"),
        "stream_event_weather_join": _same_as("event_weather_join"),
        "stream_avg_tone_by_temp": _same_as("avg_tone_by_temp"),
        "stream_avg_mentions_by_temp": _same_as("avg_mentions_by_temp"),
        "stream_avg_tone_sliding": _same_as("avg_tone_sliding"),
        "stream_avg_mentions_sliding": _same_as("avg_mentions_sliding"),
        "stream_avg_tone_riots": _same_as("avg_tone_riots"),
        "stream_sink_csv": FILE_SQL["sink_csv"],
        "stream_ingest_rejects": FILE_SQL["ingest_rejects"],
        "stream_late_drop": oracle_with(
            "SELECT strftime(day, '%Y-%m-%dT00:00:00Z') AS window_start, count(*) AS n,\n"
            " CAST(CASE WHEN day - first >= 0 AND (day - first) * 6 < last - first + 1 THEN count(*) ELSE 0 END AS BIGINT) AS late\n"
            "FROM fx_event, (SELECT min(day) AS first, max(day) AS last FROM fx_event)\n"
            "WHERE day IS NOT NULL GROUP BY day, first, last"
        ),
    }
