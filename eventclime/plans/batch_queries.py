"""Registered batch queries over the derived fixture views, each with the
equivalent SQL for an independent engine.

Presentation rules shared by both sides: window starts and days are ISO
text, doubles are rounded to 6 places (km to 3), so two engines agree
despite last-bit differences of their maths libraries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import distance_km
from ..functions.timefmt import render_instant
from ..operators import aggregates, filters, weather, windows
from ..operators.nearest import nearest_station
from ..session import prepare
from ..sources.fixtures import load_fixture, oracle_with

ISO_SQL = "%Y-%m-%dT%H:%M:%SZ"


def _fx(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    prepare(spark)
    return load_fixture(spark, sf_dir)


def _day_text(c):
    return F.date_format(c, "yyyy-MM-dd")


# Two engines divide alike only to the last bit, so an average that is exactly
# a decimal half at the 7th place is brought to 12 decimal places first.

def _r6(c):
    return F.round(c.cast("decimal(28,12)"), 6).cast("double")


def _r6_sql(expr: str) -> str:
    return f"CAST(round(CAST(({expr}) AS DECIMAL(28,12)), 6) AS DOUBLE)"


def _present(df: DataFrame) -> DataFrame:
    out = df
    if "window_start" in df.columns:
        out = out.withColumn("window_start", render_instant(F.col("window_start")))
    if "pct" in df.columns:
        out = out.withColumn("pct", F.round(F.col("pct"), 6))
    if "value" in df.columns:
        out = out.withColumn("value", _r6(F.col("value")))
    return out


# ------------------------------------------------------------ windowed counts

def q_instability_index(spark, sf_dir):
    return _present(windows.instability_index(_fx(spark, sf_dir)["events"]))


def q_attention_share(spark, sf_dir):
    return _present(windows.attention_share(_fx(spark, sf_dir)["events"]))


def q_count_by_country_2d(spark, sf_dir):
    return _present(windows.count_by_country(_fx(spark, sf_dir)["events"], "2 days"))


def q_count_all_2d(spark, sf_dir):
    return _present(windows.count_all(_fx(spark, sf_dir)["events"], "2 days"))


def q_count_all_1d(spark, sf_dir):
    return _present(windows.count_all(_fx(spark, sf_dir)["events"], "1 day"))


def q_count_conflict_1d(spark, sf_dir):
    return _present(windows.count_conflict(_fx(spark, sf_dir)["events"], "1 day"))


# ------------------------------------------------------------------ filters

def q_filter_us_root_events(spark, sf_dir):
    ev = filters.filter_us_root_events(_fx(spark, sf_dir)["events"])
    return ev.select("globalEventID", _day_text(F.col("day")).alias("day"), "eventGeo_lat", "eventGeo_long", "avgTone")


def q_filter_country_list(spark, sf_dir):
    ev = filters.filter_country_list(_fx(spark, sf_dir)["events"])
    return ev.select("globalEventID", _day_text(F.col("day")).alias("day"), "eventGeo_countryCode")


def q_filter_conflict(spark, sf_dir):
    ev = filters.filter_conflict(_fx(spark, sf_dir)["events"])
    return ev.select("globalEventID", "quadClass", "eventRootCode")


def q_filter_weather_since(spark, sf_dir):
    w = filters.filter_weather_since(_fx(spark, sf_dir)["weather"], "2024-01-15")
    return w.select("id", _day_text(F.col("date")).alias("date"), "element", "datavalue")


def q_filter_weather_element(spark, sf_dir):
    w = filters.filter_weather_element(_fx(spark, sf_dir)["weather"])
    return w.select("id", _day_text(F.col("date")).alias("date"), "element", "datavalue")


def q_filter_station_prefix(spark, sf_dir):
    return filters.filter_station_prefix(_fx(spark, sf_dir)["stations"]).select("id", "latitude", "longitude", "ord")


# --------------------------------------------------------------------- geo

def q_distance_km(spark, sf_dir):
    """Every geocoded event against one station chosen from its id."""
    fx = _fx(spark, sf_dir)
    st = fx["stations"]
    n = st.agg(F.count(F.lit(1))).scalar()
    ev = fx["events"].where(F.col("eventGeo_lat").isNotNull())
    j = ev.join(st, F.col("ord") == F.lit(1) + F.pmod(F.col("globalEventID"), n))
    return j.select(
        "globalEventID", F.col("id").alias("station_id"),
        F.round(distance_km("eventGeo_lat", "eventGeo_long", "latitude", "longitude"), 3).alias("km"),
    )


def q_station_distance(spark, sf_dir):
    """Station-to-station distance for each station and its successor."""
    st = _fx(spark, sf_dir)["stations"]
    a = st.select(F.col("id").alias("id1"), F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"), F.col("ord").alias("o1"))
    b = st.select(F.col("id").alias("id2"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), F.col("ord").alias("o2"))
    return a.join(b, F.col("o2") == F.col("o1") + 1).select(
        "id1", "id2", F.round(distance_km("lat1", "lon1", "lat2", "lon2"), 3).alias("km")
    )


def q_nearest_station(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    ev = filters.filter_us_root_events(fx["events"])
    located = nearest_station(ev, filters.filter_station_prefix(fx["stations"]))
    return located.select("globalEventID", "station_id", F.round("station_km", 3).alias("km"))


def q_nearest_station_grid(spark, sf_dir):
    """Per-row lookup through the stream grid (no coordinate dedupe)."""
    from ..streaming.pipeline import station_lookup_grid, located_event_stream

    fx = _fx(spark, sf_dir)
    grid = station_lookup_grid(spark, filters.filter_station_prefix(fx["stations"]))
    located = located_event_stream(fx["events"], grid)
    return located.select("globalEventID", "station_id", F.round("station_km", 3).alias("km"))


# ------------------------------------------------------------ weather jobs

def q_event_weather_join(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    j = weather.event_weather_join(fx["events"], fx["weather"], fx["stations"])
    return j.select("globalEventID", _day_text(F.col("day")).alias("day"), F.round("value", 6).alias("value"), "temp")


def q_classify_temperature(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    j = weather.classify_temperature(weather.event_weather_join(fx["events"], fx["weather"], fx["stations"]))
    return j.select("globalEventID", _day_text(F.col("day")).alias("day"), "temp", "clz")


def _avg(spark, sf_dir, value, **kw):
    fx = _fx(spark, sf_dir)
    return _present(aggregates.avg_by_weather_class(fx["events"], fx["weather"], fx["stations"], value=value, **kw))


def q_avg_tone_by_temp(spark, sf_dir):
    return _avg(spark, sf_dir, "avgTone")


def q_avg_mentions_by_temp(spark, sf_dir):
    return _avg(spark, sf_dir, "numMentions")


# millimetres of rain, in the reading's tenths
PRECIPITATION_RULES = (("dry", 1.0), ("wet", 20.0), ("heavy", 1000.0))


def q_avg_mentions_by_precip(spark, sf_dir):
    return _avg(spark, sf_dir, "numMentions", element="PRCP", rules=PRECIPITATION_RULES)


def q_avg_tone_riots(spark, sf_dir):
    return _avg(spark, sf_dir, "avgTone", extra_filter=filters.riot_event())


def q_avg_mentions_riots(spark, sf_dir):
    return _avg(spark, sf_dir, "numMentions", extra_filter=filters.riot_event())


def q_avg_tone_sliding(spark, sf_dir):
    return _avg(spark, sf_dir, "avgTone", size="4 days", slide="2 days")


def q_avg_mentions_sliding(spark, sf_dir):
    return _avg(spark, sf_dir, "numMentions", size="4 days", slide="2 days")


def q_series_pivot(spark, sf_dir):
    fx = _fx(spark, sf_dir)
    res = aggregates.avg_by_weather_class(fx["events"], fx["weather"], fx["stations"])
    piv = aggregates.series_pivot(res)
    return piv.select(
        render_instant(F.col("window_start")).alias("window_start"),
        *[_r6(F.col(c)).alias(c) for c in ("low", "mid", "high")],
    )


QUERIES = {
    "instability_index": q_instability_index,
    "attention_share": q_attention_share,
    "count_by_country_2d": q_count_by_country_2d,
    "count_all_2d": q_count_all_2d,
    "count_all_1d": q_count_all_1d,
    "count_conflict_1d": q_count_conflict_1d,
    "filter_us_root_events": q_filter_us_root_events,
    "filter_country_list": q_filter_country_list,
    "filter_conflict": q_filter_conflict,
    "filter_weather_since": q_filter_weather_since,
    "filter_weather_element": q_filter_weather_element,
    "filter_station_prefix": q_filter_station_prefix,
    "distance_km": q_distance_km,
    "station_distance": q_station_distance,
    "nearest_station": q_nearest_station,
    "nearest_station_grid": q_nearest_station_grid,
    "event_weather_join": q_event_weather_join,
    "classify_temperature": q_classify_temperature,
    "avg_tone_by_temp": q_avg_tone_by_temp,
    "avg_mentions_by_temp": q_avg_mentions_by_temp,
    "avg_mentions_by_precip": q_avg_mentions_by_precip,
    "avg_tone_riots": q_avg_tone_riots,
    "avg_mentions_riots": q_avg_mentions_riots,
    "avg_tone_sliding": q_avg_tone_sliding,
    "avg_mentions_sliding": q_avg_mentions_sliding,
    "series_pivot": q_series_pivot,
}


# ------------------------------------------------------------- oracle SQL

def _iso(expr: str) -> str:
    return f"strftime({expr}, '{ISO_SQL}')"


def _bucket(days: int, col: str = "day") -> str:
    return f"time_bucket(INTERVAL '{days} days', CAST({col} AS TIMESTAMP), TIMESTAMP '1970-01-01')"


_DIST = (
    "(acos(least(CAST(1 AS DOUBLE), greatest(CAST(-1 AS DOUBLE),"
    " sin({a} * pi() / 180) * sin({c} * pi() / 180)"
    " + cos({a} * pi() / 180) * cos({c} * pi() / 180) * cos(({b} - {d}) * pi() / 180))))"
    " * 180 / pi() * 60 * CAST('1.1515' AS DOUBLE) * CAST('1.609344' AS DOUBLE))"
)


def _dist(a, b, c, d) -> str:
    return _DIST.format(a=a, b=b, c=c, d=d)


_US_ROOT = (
    "actor1Code_countryCode = 'USA' AND eventGeo_lat IS NOT NULL AND eventGeo_long IS NOT NULL"
    " AND isnan(eventGeo_lat) = false AND isnan(eventGeo_long) = false AND coalesce(isRoot, false)"
)
_CONFLICT = "(coalesce(quadClass = 4, false) OR coalesce(eventRootCode = '14', false))"
_COUNTRIES = "('US', 'UK', 'NK', 'CH', 'IN', 'DE', 'FR')"

# nearest USC station per distinct event coordinate (brute force is fine for
# the oracle at test scale), then per event
_NEAREST_CTE = f"""
usc AS (SELECT * FROM fx_station WHERE starts_with(id, 'USC')),
pts AS (SELECT DISTINCT eventGeo_lat AS lat, eventGeo_long AS lon FROM fx_event WHERE {_US_ROOT}),
cand AS (SELECT p.lat, p.lon, s.id, s.ord, {_dist('p.lat', 'p.lon', 's.latitude', 's.longitude')} AS km
         FROM pts p CROSS JOIN usc s),
best AS (SELECT lat, lon, id AS station_id, km FROM (
           SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY round(km, 6), ord) AS rn FROM cand) WHERE rn = 1),
located AS (SELECT e.*, b.station_id, b.km AS station_km FROM fx_event e
            JOIN best b ON e.eventGeo_lat = b.lat AND e.eventGeo_long = b.lon WHERE {_US_ROOT}),
readings AS (SELECT id, date, TRY_CAST(datavalue AS DOUBLE) / CAST(10 AS DOUBLE) AS temp FROM fx_weather
             WHERE date > DATE '2017-01-31' AND element = 'TMAX' AND TRY_CAST(datavalue AS DOUBLE) IS NOT NULL),
ew AS (SELECT l.globalEventID, l.day, l.avgTone, l.numMentions, l.eventRootCode, r.temp,
              CASE WHEN r.temp < 5 THEN 'low' WHEN r.temp < 25 THEN 'mid' WHEN r.temp < 2147483647 THEN 'high' END AS clz
       FROM located l JOIN readings r ON l.station_id = r.id AND l.day = r.date)
"""


def _avg_sql(value: str, where: str = "TRUE", days: int = 1) -> str:
    return oracle_with(
        f"SELECT {_iso(_bucket(days))} AS window_start, clz, {_r6_sql(f'sum({value}) / count({value})')} AS value\n"
        f"FROM ew WHERE clz IS NOT NULL AND {where} GROUP BY 1, 2 HAVING count({value}) > 0",
        _NEAREST_CTE,
    )


def _sliding_sql(value: str) -> str:
    # every day lies in the 4-day windows starting at its 2-day bucket and
    # two days before it
    return oracle_with(
        f"SELECT {_iso('ws')} AS window_start, clz, {_r6_sql(f'sum({value}) / count({value})')} AS value\n"
        f"FROM sl GROUP BY 1, 2 HAVING count({value}) > 0",
        _NEAREST_CTE + ",\n"
        "sl AS (SELECT " + _bucket(2) + " AS ws, * FROM ew WHERE clz IS NOT NULL\n"
        "       UNION ALL SELECT " + _bucket(2) + " - INTERVAL '2 days' AS ws, * FROM ew WHERE clz IS NOT NULL)",
    )


def _with_nearest(body: str, more: str = "") -> str:
    return oracle_with(body, _NEAREST_CTE + ("," + more if more else ""))


ORACLE_SQL = {
    "instability_index": oracle_with(
        f"SELECT {_iso(_bucket(1))} AS window_start,"
        f" round(CAST(count(*) FILTER (WHERE {_CONFLICT}) AS DOUBLE) / count(*) * 100, 6) AS pct\n"
        f"FROM fx_event GROUP BY 1 HAVING count(*) FILTER (WHERE {_CONFLICT}) > 0"
    ),
    "attention_share": oracle_with(
        f"SELECT c.window_start, c.country, round(CAST(c.n AS DOUBLE) / a.n * 100, 6) AS pct FROM\n"
        f"(SELECT {_iso(_bucket(2))} AS window_start, eventGeo_countryCode AS country, count(*) AS n\n"
        f" FROM fx_event WHERE eventGeo_countryCode IN {_COUNTRIES} GROUP BY 1, 2) c\n"
        f"JOIN (SELECT {_iso(_bucket(2))} AS window_start, count(*) AS n FROM fx_event GROUP BY 1) a\n"
        f"ON c.window_start = a.window_start"
    ),
    "count_by_country_2d": oracle_with(
        f"SELECT {_iso(_bucket(2))} AS window_start, eventGeo_countryCode AS country, count(*) AS n\n"
        f"FROM fx_event WHERE eventGeo_countryCode IN {_COUNTRIES} GROUP BY 1, 2"
    ),
    "count_all_2d": oracle_with(f"SELECT {_iso(_bucket(2))} AS window_start, count(*) AS n FROM fx_event GROUP BY 1"),
    "count_all_1d": oracle_with(f"SELECT {_iso(_bucket(1))} AS window_start, count(*) AS n FROM fx_event GROUP BY 1"),
    "count_conflict_1d": oracle_with(
        f"SELECT {_iso(_bucket(1))} AS window_start, count(*) AS n FROM fx_event WHERE {_CONFLICT} GROUP BY 1"
    ),
    "filter_us_root_events": oracle_with(
        f"SELECT globalEventID, strftime(day, '%Y-%m-%d') AS day, eventGeo_lat, eventGeo_long, avgTone\n"
        f"FROM fx_event WHERE {_US_ROOT}"
    ),
    "filter_country_list": oracle_with(
        f"SELECT globalEventID, strftime(day, '%Y-%m-%d') AS day, eventGeo_countryCode FROM fx_event\n"
        f"WHERE eventGeo_countryCode IN {_COUNTRIES}"
    ),
    "filter_conflict": oracle_with(f"SELECT globalEventID, quadClass, eventRootCode FROM fx_event WHERE {_CONFLICT}"),
    "filter_weather_since": oracle_with(
        "SELECT id, strftime(date, '%Y-%m-%d') AS date, element, datavalue FROM fx_weather WHERE date > DATE '2024-01-15'"
    ),
    "filter_weather_element": oracle_with(
        "SELECT id, strftime(date, '%Y-%m-%d') AS date, element, datavalue FROM fx_weather WHERE element = 'TMAX'"
    ),
    "filter_station_prefix": oracle_with(
        "SELECT id, latitude, longitude, ord FROM fx_station WHERE starts_with(id, 'USC')"
    ),
    "distance_km": oracle_with(
        "SELECT e.globalEventID, s.id AS station_id,"
        f" round({_dist('e.eventGeo_lat', 'e.eventGeo_long', 's.latitude', 's.longitude')}, 3) AS km\n"
        "FROM fx_event e JOIN fx_station s ON s.ord = 1 + e.globalEventID % (SELECT count(*) FROM fx_station)\n"
        "WHERE e.eventGeo_lat IS NOT NULL"
    ),
    "station_distance": oracle_with(
        f"SELECT a.id AS id1, b.id AS id2, round({_dist('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 3) AS km\n"
        "FROM fx_station a JOIN fx_station b ON b.ord = a.ord + 1"
    ),
    "nearest_station": _with_nearest(
        "SELECT globalEventID, station_id, round(station_km, 3) AS km FROM located"
    ),
    "nearest_station_grid": _with_nearest(
        "SELECT globalEventID, station_id, round(station_km, 3) AS km FROM located"
    ),
    "event_weather_join": _with_nearest(
        "SELECT globalEventID, strftime(day, '%Y-%m-%d') AS day, round(avgTone, 6) AS value, temp FROM ew"
    ),
    "classify_temperature": _with_nearest(
        "SELECT globalEventID, strftime(day, '%Y-%m-%d') AS day, temp, clz FROM ew WHERE clz IS NOT NULL"
    ),
    "avg_tone_by_temp": _avg_sql("avgTone"),
    "avg_mentions_by_temp": _avg_sql("numMentions"),
    "avg_mentions_by_precip": _avg_sql("numMentions").replace("element = 'TMAX'", "element = 'PRCP'").replace(
        "CASE WHEN r.temp < 5 THEN 'low' WHEN r.temp < 25 THEN 'mid' WHEN r.temp < 2147483647 THEN 'high' END",
        "CASE WHEN r.temp < 1 THEN 'dry' WHEN r.temp < 20 THEN 'wet' WHEN r.temp < 1000 THEN 'heavy' END"),
    "avg_tone_riots": _avg_sql("avgTone", "coalesce(eventRootCode = '14', false)"),
    "avg_mentions_riots": _avg_sql("numMentions", "coalesce(eventRootCode = '14', false)"),
    "avg_tone_sliding": _sliding_sql("avgTone"),
    "avg_mentions_sliding": _sliding_sql("numMentions"),
    "series_pivot": _with_nearest(
        "SELECT window_start,"
        " " + _r6_sql("max(v) FILTER (WHERE clz = 'low')") + " AS low,"
        " " + _r6_sql("max(v) FILTER (WHERE clz = 'mid')") + " AS mid,"
        " " + _r6_sql("max(v) FILTER (WHERE clz NOT IN ('low', 'mid'))") + " AS high\n"
        "FROM av GROUP BY window_start",
        "av AS (SELECT " + _iso(_bucket(1)) + " AS window_start, clz, sum(avgTone) / count(avgTone) AS v\n"
        "        FROM ew WHERE clz IS NOT NULL GROUP BY 1, 2 HAVING count(avgTone) > 0)",
    ),
}
