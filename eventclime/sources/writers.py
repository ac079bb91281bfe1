"""Render DataFrames as the text formats the sources read (used to make
file inputs from tables, e.g. the round-trip checks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EVENT_COLUMNS


def _token(df: DataFrame, name: str, typ: str) -> Column:
    if name not in df.columns:
        return F.lit("")
    c = F.col(name)
    if typ == "date":
        s = F.date_format(c, "yyyyMMdd")
    elif typ == "boolean":
        s = F.when(c, F.lit("1")).when(~c, F.lit("0"))
    else:
        s = c.cast("string")
    return F.coalesce(s, F.lit(""))


def event_tokens(df: DataFrame) -> Column:
    """The 58 text tokens of an event row (missing columns are empty)."""
    return F.array(*[_token(df, n, t) for n, t in EVENT_COLUMNS])


_POS = {name: i for i, (name, _) in enumerate(EVENT_COLUMNS)}


def _set(toks: Column, name: str, value: Column) -> Column:
    """Replace one token (by column name) in a token array."""
    i = _POS[name]
    return F.concat(F.slice(toks, 1, i), F.array(value), F.slice(toks, i + 2, len(EVENT_COLUMNS)))


# kinds of damaged rows written by ``dirty_event_lines``: (kind, meaning)
DIRTY_KINDS = {
    0: "57 fields (source URL missing) - kept",
    1: "52 fields (ends inside a geo group) - rejected",
    2: "59 fields - rejected",
    3: "day 20171332 - rejected",
    4: "empty day - rejected",
    5: "latitude 'x' - kept, null",
    6: "quad class with decimals - kept, null",
    7: "CRLF line end - kept",
    8: "empty root flag - kept, null",
    9: "mentions with blanks - kept, null",
    10: "a double quote inside a field - kept literally",
}
DIRTY_MODULUS = 50


def dirty_event_lines(events: DataFrame) -> DataFrame:
    """Every event as a TSV line; rows are damaged by a rule on their id so
    each kind of malformed input occurs throughout the file."""
    toks = event_tokens(events)
    k = F.pmod(F.col("globalEventID"), F.lit(DIRTY_MODULUS))
    n = len(EVENT_COLUMNS)
    damaged = (
        F.when(k == 0, F.slice(toks, 1, n - 1))
        .when(k == 1, F.slice(toks, 1, 52))
        .when(k == 2, F.concat(toks, F.array(F.lit("extra"))))
        .when(k == 3, _set(toks, "day", F.lit("20171332")))
        .when(k == 4, _set(toks, "day", F.lit("")))
        .when(k == 5, _set(toks, "eventGeo_lat", F.lit("x")))
        .when(k == 6, _set(toks, "quadClass", F.coalesce(F.concat(F.col("quadClass").cast("string"), F.lit(".0")), F.lit(""))))
        .when(k == 7, _set(toks, "sourceUrl", F.lit("\r")))
        .when(k == 8, _set(toks, "isRoot", F.lit("")))
        .when(k == 9, _set(toks, "numMentions", F.concat(F.lit(" "), F.col("numMentions").cast("string"), F.lit(" "))))
        .when(k == 10, _set(toks, "actor1Code_name", F.lit('"a')))
        .otherwise(toks)
    )
    return events.select(F.array_join(damaged, "\t", "").alias("value"))


def event_lines(events: DataFrame) -> DataFrame:
    return events.select(F.array_join(event_tokens(events), "\t", "").alias("value"))


def weather_lines(weather: DataFrame) -> DataFrame:
    """Readings in the public eight-field layout (flags empty)."""
    return weather.select(
        F.concat_ws(
            ",", F.col("id"), F.date_format("date", "yyyyMMdd"), F.col("element"), F.col("datavalue"),
            F.lit(""), F.lit(""), F.lit("7"), F.lit(""),
        ).alias("value")
    )


def station_lines(stations: DataFrame) -> DataFrame:
    """Blank-separated station lines: id, latitude, longitude, elevation, name."""
    return stations.select(
        F.concat_ws(
            "  ", F.col("id"), F.col("latitude").cast("string"), F.col("longitude").cast("string"),
            F.lit("100.0"), F.concat(F.lit("STATION "), F.col("ord").cast("string")),
        ).alias("value")
    )


def dirty_weather_lines(weather: DataFrame) -> DataFrame:
    """Readings as lines; those of days 1 and 2 of a month are damaged (three
    fields; an impossible date)."""
    day, date = F.dayofmonth("date"), F.date_format("date", "yyyyMMdd")
    line = (
        F.when(day == 1, F.concat_ws(",", "id", date, "element"))
        .when(day == 2, F.concat_ws(",", F.col("id"), F.lit("20171332"), F.col("element"), F.col("datavalue")))
        .otherwise(F.concat_ws(",", F.col("id"), date, F.col("element"), F.col("datavalue")))
    )
    return weather.select(line.alias("value"))


def dirty_station_lines(stations: DataFrame) -> DataFrame:
    """Stations as lines; every fifth is cut after its latitude and every
    fifth plus one has a latitude that is no number."""
    k = F.pmod(F.col("ord"), F.lit(5))
    lat, lon = F.col("latitude").cast("string"), F.col("longitude").cast("string")
    line = (
        F.when(k == 0, F.concat_ws(" ", F.col("id"), lat))
        .when(k == 1, F.concat_ws(" ", F.col("id"), F.lit("x"), lon, F.lit("100.0")))
        .otherwise(F.concat_ws(" ", F.col("id"), lat, lon, F.lit("100.0")))
    )
    return stations.select(line.alias("value"))


def write_lines(lines: DataFrame, path: str) -> str:
    lines.write.mode("overwrite").text(path)
    return path
