"""Job-level entry points: read the raw files, run one analysis, write the
result CSV (batch), or start the same analysis as a streaming query.

    avg_by_weather_class(events, weather, stations, value="avgTone", ...)
    attention_share(events, countries=[...], size="2 days")
    instability_index(events, size="1 day")

take DataFrames (batch or streaming) and return DataFrames; the ``run_*``
functions below wire them to files the way the original jobs were used.
"""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import DEFAULT_TEMP_RULES
from ..operators.aggregates import avg_by_weather_class, series_pivot
from ..operators.filters import (
    ACTOR_COUNTRY, ATTENTION_COUNTRIES, STATION_PREFIX, WEATHER_AFTER, WEATHER_ELEMENT, riot_event, station_prefix,
)
from ..operators.windows import EVENT_TS, attention_share, count_all, instability_index, with_event_time
from ..session import build_session, prepare
from ..sources import text
from ..sources.sinks import write_result_csv
from ..streaming import pipeline as P
from ..streaming.runner import Input, StreamJob, run_job

__all__ = [
    "avg_by_weather_class", "attention_share", "instability_index", "series_pivot",
    "run_avg_job", "run_attention_job", "run_instability_job",
    "start_instability_stream", "start_attention_stream", "start_avg_stream", "start_count_stream", "StreamJob",
]


def run_avg_job(
    spark: SparkSession,
    events_path: str,
    weather_path: str,
    stations_path: str,
    out_path: str,
    value: str = "avgTone",
    element: str = WEATHER_ELEMENT,
    rules=DEFAULT_TEMP_RULES,
    size: str = "1 day",
    slide: str | None = None,
    riots_only: bool = False,
    after: dt.date | str = WEATHER_AFTER,
    actor_country: str = ACTOR_COUNTRY,
    prefix: str = STATION_PREFIX,
    max_km: float | None = None,
) -> str:
    """Average tone (or mentions) per day and temperature class -> CSV."""
    prepare(spark)
    res = avg_by_weather_class(
        text.read_events(spark, events_path), text.read_weather(spark, weather_path),
        text.read_stations(spark, stations_path), value=value, element=element, rules=rules,
        size=size, slide=slide, extra_filter=riot_event() if riots_only else None, after=after,
        actor_country=actor_country, prefix=prefix, max_km=max_km,
    )
    return write_result_csv(res, out_path)


def run_attention_job(spark: SparkSession, events_path: str, out_path: str,
                      countries: Sequence[str] = ATTENTION_COUNTRIES, size: str = "2 days") -> str:
    prepare(spark)
    return write_result_csv(attention_share(text.read_events(spark, events_path), countries, size), out_path)


def run_instability_job(spark: SparkSession, events_path: str, out_path: str, size: str = "1 day") -> str:
    prepare(spark)
    return write_result_csv(instability_index(text.read_events(spark, events_path), size), out_path)


# ---------------------------------------------------------------- streaming
#
# Each job parses its lines once (good rows, late rows, rejects), analyses the
# good rows and publishes one CSV file: see ``streaming.runner``.  A job whose
# trigger is ``availableNow`` (the default) has run to its end when it is
# returned; the last windows are in the file too, and a later run on the same
# checkpoint goes on with them.

def _event_input(spark: SparkSession, folder: str, columns: Sequence[str], files_per_batch: int | None,
                 actor_country: str = ACTOR_COUNTRY) -> Input:
    return Input(P.stream_text(spark, folder, files_per_batch), text.parse_event_lines, ["day", *columns], "day",
                 lambda rows: P.event_sentinel(rows, actor_country))


def _timed(events: DataFrame, delay: str) -> DataFrame:
    return P.with_watermark(with_event_time(events), EVENT_TS, delay)


def start_instability_stream(spark, events_dir, out_dir, checkpoint_dir, files_per_batch=None,
                             delay="0 seconds", trigger=None, size="1 day", close=None, state_partitions=None) -> StreamJob:
    """The instability index per window, as one CSV file."""
    prepare(spark)
    return run_job(spark, lambda events: instability_index(_timed(events, delay), size),
                   {"events": _event_input(spark, events_dir, ["quadClass", "eventRootCode"], files_per_batch)},
                   out_dir, checkpoint_dir, trigger, close, state_partitions, (size, None), delay)


def start_count_stream(spark, events_dir, out_dir, checkpoint_dir, files_per_batch=None, delay="0 seconds",
                       trigger=None, size="1 day", close=None, state_partitions=None) -> StreamJob:
    """Events per window, as one CSV file."""
    prepare(spark)
    return run_job(spark, lambda events: count_all(_timed(events, delay), size),
                   {"events": _event_input(spark, events_dir, [], files_per_batch)},
                   out_dir, checkpoint_dir, trigger, close, state_partitions, (size, None), delay)


def start_attention_stream(spark, events_dir, out_dir, checkpoint_dir, countries=ATTENTION_COUNTRIES,
                           size="2 days", files_per_batch=None, delay="0 seconds", trigger=None,
                           close=None, state_partitions=None) -> StreamJob:
    """Each listed country's share of the events per window, as one CSV file."""
    prepare(spark)
    return run_job(spark, lambda events: attention_share(_timed(events, delay), countries, size),
                   {"events": _event_input(spark, events_dir, ["eventGeo_countryCode"], files_per_batch)},
                   out_dir, checkpoint_dir, trigger, close, state_partitions, (size, None), delay)


def start_avg_stream(spark, events_dir, weather_dir, stations_path, out_dir, checkpoint_dir,
                     value="avgTone", files_per_batch=None, delay="0 seconds", trigger=None,
                     riots_only=False, element=WEATHER_ELEMENT, rules=DEFAULT_TEMP_RULES, size="1 day", slide=None,
                     after=WEATHER_AFTER, actor_country=ACTOR_COUNTRY, prefix=STATION_PREFIX, max_km=None,
                     close=None, state_partitions=None) -> StreamJob:
    """Event stream x weather stream -> average per window and class, as one
    CSV file."""
    prepare(spark)
    grid = P.station_lookup_grid(spark, text.read_stations(spark, stations_path).where(station_prefix(prefix)))

    def build(events, weather):
        located = P.located_event_stream(_timed(events, delay), grid, riot_event() if riots_only else None, actor_country)
        if max_km is not None:
            located = located.where(F.col("station_km") <= F.lit(float(max_km)))
        readings = P.with_watermark(P.weather_stream_readings(weather, element, after), P.WEATHER_TS, delay)
        return P.stream_avg_by_weather_class(located, readings, value, rules, size, slide)

    columns = ["actor1Code_countryCode", "isRoot", "eventRootCode", "eventGeo_lat", "eventGeo_long", value]
    weather = Input(P.stream_text(spark, weather_dir, files_per_batch), text.parse_weather_lines,
                    ["id", "date", "element", "datavalue"], "date", lambda rows: P.reading_sentinel(rows, element))
    return run_job(spark, build, {"events": _event_input(spark, events_dir, columns, files_per_batch, actor_country), "weather": weather},
                   out_dir, checkpoint_dir, trigger, close, state_partitions, (size, slide), delay)


def main(argv: Sequence[str] | None = None) -> None:
    """Run one job over files: as a batch, or with ``--checkpoint`` as a stream
    job that takes what has arrived since its last run."""
    ap = argparse.ArgumentParser(prog="eventclime")
    ap.add_argument("job", choices=["avg-tone", "avg-mentions", "attention", "instability"])
    ap.add_argument("--path", required=True, help="event TSV file or folder")
    ap.add_argument("--wpath", help="weather CSV file or folder")
    ap.add_argument("--stations", help="station list file")
    ap.add_argument("--out", required=True, help="result CSV folder")
    ap.add_argument("--checkpoint", help="folder of a stream job's progress; the inputs are folders then")
    ap.add_argument("--window", help="window size, like '1 day' (attention: '2 days')")
    ap.add_argument("--slide", help="slide of the averages' window; none: tumbling")
    ap.add_argument("--delay", default="0 seconds", help="how long a stream job waits for late rows")
    ap.add_argument("--riots", action="store_true", help="averages of riots only")
    ap.add_argument("--element", default=WEATHER_ELEMENT, help="weather element, like TMAX")
    ap.add_argument("--after", default=WEATHER_AFTER, type=dt.date.fromisoformat, help="readings strictly after this day")
    ap.add_argument("--actor-country", default=ACTOR_COUNTRY)
    ap.add_argument("--prefix", default=STATION_PREFIX, help="prefix of the station ids that take part")
    ap.add_argument("--max-km", type=float, help="farthest nearest station")
    ap.add_argument("--country", action="append", dest="countries", help="country of the attention job (repeatable)")
    a = ap.parse_args(argv)
    averages = a.job in ("avg-tone", "avg-mentions")
    if averages and not (a.wpath and a.stations):
        ap.error(f"{a.job} needs --wpath and --stations")
    size = a.window or ("2 days" if a.job == "attention" else "1 day")
    spark = build_session(master="local[*]")
    late = {"delay": a.delay} if a.checkpoint else {}
    if averages:
        how = dict(value="avgTone" if a.job == "avg-tone" else "numMentions", element=a.element, size=size, slide=a.slide,
                   riots_only=a.riots, after=a.after, actor_country=a.actor_country, prefix=a.prefix, max_km=a.max_km)
        if a.checkpoint:
            start_avg_stream(spark, a.path, a.wpath, a.stations, a.out, a.checkpoint, **how, **late)
        else:
            run_avg_job(spark, a.path, a.wpath, a.stations, a.out, **how)
    elif a.job == "attention":
        how = dict(countries=a.countries or ATTENTION_COUNTRIES, size=size)
        if a.checkpoint:
            start_attention_stream(spark, a.path, a.out, a.checkpoint, **how, **late)
        else:
            run_attention_job(spark, a.path, a.out, **how)
    elif a.checkpoint:
        start_instability_stream(spark, a.path, a.out, a.checkpoint, size=size, **late)
    else:
        run_instability_job(spark, a.path, a.out, size)


if __name__ == "__main__":
    main()
