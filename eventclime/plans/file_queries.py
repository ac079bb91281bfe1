"""Round-trip queries: the fixture tables are written by Spark as the real
text formats (event TSV, weather CSV, station list) into the shared scratch
folder, then read back by the package's sources.  Their oracle is the same
fixture view in SQL (with the damage rule of the dirty file spelled out)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from ..session import scratch_path
from ..sources import text, writers
from ..sources.fixtures import oracle_with
from ..sources.sinks import write_result_csv
from .batch_queries import _day_text, _fx, _iso, _bucket, _CONFLICT

_EVENT_OUT = [
    "globalEventID", "day", "actor1Code_countryCode", "isRoot", "eventRootCode", "quadClass",
    "numMentions", "avgTone", "eventGeo_countryCode", "eventGeo_lat", "eventGeo_long",
]


def _event_out(df):
    return df.select(
        F.col("globalEventID").cast("long").alias("globalEventID"),
        _day_text(F.col("day")).alias("day"),
        *[F.round(F.col(c), 6).alias(c) if c == "avgTone" else F.col(c) for c in _EVENT_OUT[2:]],
    )


def write_event_files(spark, sf_dir, dirty=False) -> str:
    ev = _fx(spark, sf_dir)["events"]
    lines = writers.dirty_event_lines(ev) if dirty else writers.event_lines(ev)
    return writers.write_lines(lines, scratch_path(spark, "events-dirty" if dirty else "events-tsv"))


def q_scan_events(spark, sf_dir):
    path = write_event_files(spark, sf_dir)
    return _event_out(text.read_events(spark, path))


def q_typed_ingest(spark, sf_dir):
    path = write_event_files(spark, sf_dir, dirty=True)
    parsed = text.parse_event_lines(text.read_lines(spark, path))
    good = parsed.where(F.col(text.REASON).isNull())
    return good.select(
        F.col("globalEventID").cast("long").alias("globalEventID"),
        _day_text(F.col("day")).alias("day"),
        "isRoot", "quadClass", "numMentions",
        F.round("avgTone", 6).alias("avgTone"),
        "eventGeo_lat", "eventRootCode", "actor1Code_name", "sourceUrl",
        F.col("_n_tokens").alias("n_tokens"),
    )


def q_ingest_rejects(spark, sf_dir):
    path = write_event_files(spark, sf_dir, dirty=True)
    rej = text.read_event_rejects(spark, path)
    return rej.select(F.split(F.col("line"), "\t", 2).getItem(0).alias("event_token"), "n_tokens", "reason")


def q_event_struct_view(spark, sf_dir):
    path = write_event_files(spark, sf_dir)
    nested = text.event_struct_view(text.read_events(spark, path))
    return nested.select(
        F.col("globalEventID").cast("long").alias("globalEventID"),
        F.col("eventGeo.countryCode").alias("geo_country"),
        F.col("eventGeo.lat").alias("geo_lat"),
        F.col("actor1Code.countryCode").alias("actor1_country"),
    )


def q_scan_weather(spark, sf_dir):
    w = _fx(spark, sf_dir)["weather"]
    path = writers.write_lines(writers.weather_lines(w), scratch_path(spark, "weather-csv"))
    back = text.read_weather(spark, path)
    return back.select("id", _day_text(F.col("date")).alias("date"), "element", "datavalue")


def q_scan_stations(spark, sf_dir):
    st = _fx(spark, sf_dir)["stations"]
    path = writers.write_lines(writers.station_lines(st), scratch_path(spark, "stations-txt"))
    return text.read_stations(spark, path).select("id", "latitude", "longitude")


def q_weather_rejects(spark, sf_dir):
    w = _fx(spark, sf_dir)["weather"]
    path = writers.write_lines(writers.dirty_weather_lines(w), scratch_path(spark, "weather-dirty"))
    rej = text.read_weather_rejects(spark, path)
    return rej.groupBy(F.split(F.col("line"), ",", 2).getItem(0).alias("id"), "n_tokens", "reason").agg(
        F.count(F.lit(1)).alias("n"))


def q_station_rejects(spark, sf_dir):
    st = _fx(spark, sf_dir)["stations"]
    path = writers.write_lines(writers.dirty_station_lines(st), scratch_path(spark, "stations-dirty"))
    return text.read_station_rejects(spark, path).select(
        F.split(F.col("line"), " ", 2).getItem(0).alias("id"), "n_tokens", "reason")


def q_sink_csv(spark, sf_dir):
    """Instability result written as the job's CSV, read back as the plotter does."""
    res = windows.instability_index(_fx(spark, sf_dir)["events"])
    path = write_result_csv(res, scratch_path(spark, "global-instability-csv"))
    back = spark.read.schema("window_start string, pct double").csv(path)
    return back.select("window_start", F.round("pct", 6).alias("pct"))


QUERIES = {
    "scan_events": q_scan_events,
    "typed_ingest": q_typed_ingest,
    "ingest_rejects": q_ingest_rejects,
    "event_struct_view": q_event_struct_view,
    "scan_weather": q_scan_weather,
    "scan_stations": q_scan_stations,
    "weather_rejects": q_weather_rejects,
    "station_rejects": q_station_rejects,
    "sink_csv": q_sink_csv,
}

_EVENT_SQL_OUT = (
    "CAST(globalEventID AS BIGINT) AS globalEventID, strftime(day, '%Y-%m-%d') AS day, actor1Code_countryCode,"
    " isRoot, eventRootCode, quadClass, numMentions, round(avgTone, 6) AS avgTone, eventGeo_countryCode,"
    " eventGeo_lat, eventGeo_long"
)

ORACLE_SQL = {
    "scan_events": oracle_with(f"SELECT {_EVENT_SQL_OUT} FROM fx_event"),
    "typed_ingest": oracle_with(
        "SELECT CAST(globalEventID AS BIGINT) AS globalEventID, strftime(day, '%Y-%m-%d') AS day,\n"
        " CASE WHEN k = 8 THEN NULL ELSE isRoot END AS isRoot,\n"
        " CASE WHEN k = 6 THEN NULL ELSE quadClass END AS quadClass,\n"
        " CASE WHEN k = 9 THEN NULL ELSE numMentions END AS numMentions,\n"
        " round(avgTone, 6) AS avgTone,\n"
        " CASE WHEN k = 5 THEN NULL ELSE eventGeo_lat END AS eventGeo_lat,\n"
        " eventRootCode,\n"
        " CASE WHEN k = 10 THEN '\"a' END AS actor1Code_name,\n"
        " CAST(NULL AS VARCHAR) AS sourceUrl,\n"
        " CASE WHEN k = 0 THEN 57 ELSE 58 END AS n_tokens\n"
        "FROM (SELECT *, globalEventID % 50 AS k FROM fx_event) WHERE k NOT IN (1, 2, 3, 4)"
    ),
    "ingest_rejects": oracle_with(
        "SELECT CAST(globalEventID AS VARCHAR) AS event_token,\n"
        " CASE k WHEN 1 THEN 52 WHEN 2 THEN 59 ELSE 58 END AS n_tokens,\n"
        " CASE WHEN k IN (1, 2) THEN 'token_count' ELSE 'bad_day' END AS reason\n"
        "FROM (SELECT globalEventID, globalEventID % 50 AS k FROM fx_event) WHERE k IN (1, 2, 3, 4)"
    ),
    "event_struct_view": oracle_with(
        "SELECT CAST(globalEventID AS BIGINT) AS globalEventID, eventGeo_countryCode AS geo_country,"
        " eventGeo_lat AS geo_lat, actor1Code_countryCode AS actor1_country FROM fx_event"
    ),
    "scan_weather": oracle_with(
        "SELECT id, strftime(date, '%Y-%m-%d') AS date, element, datavalue FROM fx_weather"
    ),
    "scan_stations": oracle_with("SELECT id, latitude, longitude FROM fx_station"),
    "weather_rejects": oracle_with(
        "SELECT id, CASE day(date) WHEN 1 THEN 3 ELSE 4 END AS n_tokens,\n"
        " CASE day(date) WHEN 1 THEN 'token_count' ELSE 'bad_date' END AS reason, count(*) AS n\n"
        "FROM fx_weather WHERE day(date) IN (1, 2) GROUP BY 1, 2, 3"
    ),
    "station_rejects": oracle_with(
        "SELECT id, CASE ord % 5 WHEN 0 THEN 2 ELSE 4 END AS n_tokens,\n"
        " CASE ord % 5 WHEN 0 THEN 'token_count' ELSE 'bad_coordinate' END AS reason\n"
        "FROM fx_station WHERE ord % 5 IN (0, 1)"
    ),
    "sink_csv": oracle_with(
        f"SELECT {_iso(_bucket(1))} AS window_start,"
        f" round(CAST(count(*) FILTER (WHERE {_CONFLICT}) AS DOUBLE) / count(*) * 100, 6) AS pct\n"
        f"FROM fx_event GROUP BY 1 HAVING count(*) FILTER (WHERE {_CONFLICT}) > 0"
    ),
}
