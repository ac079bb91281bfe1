"""Row predicates of the jobs (each is a plain column expression, so Catalyst
pushes it to the scan)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import valid_coordinate

# --- fixed values: the jobs' default parameters ------------------------------
ATTENTION_COUNTRIES = ["US", "UK", "NK", "CH", "IN", "DE", "FR"]
WEATHER_AFTER = dt.date(2017, 1, 31)      # readings strictly after this day
WEATHER_ELEMENT = "TMAX"
STATION_PREFIX = "USC"
ACTOR_COUNTRY = "USA"
CONFLICT_QUAD_CLASS = 4
PROTEST_ROOT_CODE = "14"
# --- end of fixed values ----------------------------------------------------


def _true(c: Column) -> Column:
    """Null-safe truth: null counts as false."""
    return F.coalesce(c, F.lit(False))


def weather_since(after: dt.date | str = WEATHER_AFTER) -> Column:
    """Reading date strictly after ``after``."""
    return F.col("date") > F.lit(after).cast("date")


def weather_element(element: str = WEATHER_ELEMENT) -> Column:
    return F.col("element") == F.lit(element)


def us_root_event(actor_country: str = ACTOR_COUNTRY) -> Column:
    """Actor 1 is from the country, the event is geocoded and a root event."""
    return (
        (F.col("actor1Code_countryCode") == F.lit(actor_country))
        & valid_coordinate("eventGeo_lat", "eventGeo_long")
        & _true(F.col("isRoot"))
    )


def riot_event(root_code: str = PROTEST_ROOT_CODE) -> Column:
    return _true(F.col("eventRootCode") == F.lit(root_code))


def country_in(countries: Sequence[str] = ATTENTION_COUNTRIES) -> Column:
    return F.col("eventGeo_countryCode").isNotNull() & F.col("eventGeo_countryCode").isin(list(countries))


def conflict_event() -> Column:
    """Material conflict (quad class 4) or protest (root code 14)."""
    return _true(F.col("quadClass") == F.lit(CONFLICT_QUAD_CLASS)) | _true(
        F.col("eventRootCode") == F.lit(PROTEST_ROOT_CODE)
    )


def station_prefix(prefix: str = STATION_PREFIX) -> Column:
    return F.col("id").startswith(prefix)


def filter_weather_since(weather: DataFrame, after=WEATHER_AFTER) -> DataFrame:
    return weather.where(weather_since(after))


def filter_weather_element(weather: DataFrame, element: str = WEATHER_ELEMENT) -> DataFrame:
    return weather.where(weather_element(element))


def filter_us_root_events(events: DataFrame, actor_country: str = ACTOR_COUNTRY) -> DataFrame:
    return events.where(us_root_event(actor_country))


def filter_country_list(events: DataFrame, countries: Sequence[str] = ATTENTION_COUNTRIES) -> DataFrame:
    return events.where(country_in(countries))


def filter_conflict(events: DataFrame) -> DataFrame:
    return events.where(conflict_event())


def filter_station_prefix(stations: DataFrame, prefix: str = STATION_PREFIX) -> DataFrame:
    return stations.where(station_prefix(prefix))
