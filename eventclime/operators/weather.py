"""Event x weather: same station, same day (bag semantics)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import classify, temperature_from_tenths
from .filters import (
    ACTOR_COUNTRY, STATION_PREFIX, WEATHER_AFTER, WEATHER_ELEMENT,
    station_prefix, us_root_event, weather_element, weather_since,
)
from .nearest import nearest_station


def weather_readings(
    weather: DataFrame, element: str = WEATHER_ELEMENT, after: dt.date | str = WEATHER_AFTER
) -> DataFrame:
    """Readings of one element after a date, value in degrees.

    A value that is not a number gives no temperature and the reading is
    dropped.
    """
    return (
        weather.where(weather_since(after) & weather_element(element))
        .select("id", "date", temperature_from_tenths(F.col("datavalue")).alias("temp"))
        .where(F.col("temp").isNotNull())
    )


def located_events(
    events: DataFrame,
    stations: DataFrame,
    extra_filter: Column | None = None,
    actor_country: str = ACTOR_COUNTRY,
    prefix: str = STATION_PREFIX,
    max_km: float | None = None,
) -> DataFrame:
    """US root events with coordinates, each with its nearest station."""
    ev = events.where(us_root_event(actor_country))
    if extra_filter is not None:
        ev = ev.where(extra_filter)
    return nearest_station(ev, stations.where(station_prefix(prefix)), max_km=max_km)


def event_weather_join(
    events: DataFrame,
    weather: DataFrame,
    stations: DataFrame,
    value: str = "avgTone",
    element: str = WEATHER_ELEMENT,
    after: dt.date | str = WEATHER_AFTER,
    extra_filter: Column | None = None,
    max_km: float | None = None,
) -> DataFrame:
    """One row per matching (event, reading): id, day, value, temp.

    Both sides are shuffled on (station, day); a station-day holding a third
    of the events is split by adaptive skew-join handling.
    """
    ev = located_events(events, stations, extra_filter, max_km=max_km).select(
        "globalEventID", "day", F.col(value).alias("value"), "station_id"
    )
    rd = weather_readings(weather, element, after)
    return ev.join(
        rd, (F.col("station_id") == F.col("id")) & (F.col("day") == F.col("date"))
    ).select("globalEventID", "day", "value", "temp")


def classify_temperature(joined: DataFrame, rules=None) -> DataFrame:
    """Add the temperature class; rows without a class are dropped."""
    clz = classify(F.col("temp")) if rules is None else classify(F.col("temp"), rules)
    return joined.withColumn("clz", clz).where(F.col("clz").isNotNull())
