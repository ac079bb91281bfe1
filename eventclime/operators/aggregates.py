"""Averages per (window, temperature class) and the per-class series.

The plan aggregates as early as the semantics allow:

1. events -> (coordinate, day): sum and count of the value (map-side
   partial aggregation collapses a coordinate holding a third of all rows);
2. nearest station of each by its cell of the station grid (see ``nearest``);
3. -> (station, day): sum and count again, so the weather join sees at most
   one row per station-day, whatever the skew of the events;
4. classify the readings and collapse them to (station, day, class) with a
   multiplicity (copies of a reading never reach the join as rows);
5. join, weight the station-day's sum and count by the multiplicity (the bag
   semantics of joining event rows to every matching reading), and sum per
   (window, class).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.classify import DEFAULT_TEMP_RULES, classify
from .filters import ACTOR_COUNTRY, STATION_PREFIX, WEATHER_AFTER, WEATHER_ELEMENT, station_prefix, us_root_event
from .nearest import nearest_station
from .weather import weather_readings
from .windows import EVENT_TS, with_event_time


def avg_by_weather_class(
    events: DataFrame,
    weather: DataFrame,
    stations: DataFrame,
    value: str = "avgTone",
    element: str = WEATHER_ELEMENT,
    rules: Sequence[tuple[str, float]] = DEFAULT_TEMP_RULES,
    size: str = "1 day",
    slide: str | None = None,
    extra_filter: Column | None = None,
    after: dt.date | str = WEATHER_AFTER,
    actor_country: str = ACTOR_COUNTRY,
    prefix: str = STATION_PREFIX,
    max_km: float | None = None,
) -> DataFrame:
    """Average ``value`` of events per (event-time window, class of that day's
    reading at the event's nearest station): window_start, clz, value.

    Doubles are added as whole parts (see ``exact``), so the result does not
    depend on the order or partitions of the events."""
    ev = events.where(us_root_event(actor_country))
    if extra_filter is not None:
        ev = ev.where(extra_filter)
    # the events are read once and reduced to coordinate-days, whose cells
    # are then looked up
    whole, rest = exact.terms(ev, value)
    per_coord = ev.groupBy("eventGeo_lat", "eventGeo_long", "day").agg(
        F.sum(whole).alias("s"), F.sum(rest).alias("r"), F.count(value).alias("n")
    )
    located = nearest_station(per_coord, stations.where(station_prefix(prefix)), max_km=max_km)
    per_station = located.groupBy("station_id", "day").agg(
        F.sum("s").alias("s"), F.sum("r").alias("r"), F.sum("n").alias("n")
    )
    # readings collapse to (station, day, class) with a multiplicity, so a
    # station-day with many copies of its reading is one row per class
    readings = (
        weather_readings(weather, element, after)
        .withColumn("clz", classify(F.col("temp"), rules))
        .where(F.col("clz").isNotNull())
        .groupBy("id", "date", "clz")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    classified = per_station.join(
        readings, (F.col("station_id") == F.col("id")) & (F.col("day") == F.col("date"))
    ).select(
        "day", "clz",
        (F.col("s") * F.col("copies")).alias("s"),
        (F.col("r") * F.col("copies")).alias("r"),
        (F.col("n") * F.col("copies")).alias("n"),
    )
    w = F.window(EVENT_TS, size) if slide is None else F.window(EVENT_TS, size, slide)
    return (
        with_event_time(classified)
        .groupBy(w.alias("w"), "clz")
        .agg(F.sum("s").alias("s"), F.sum("r").alias("r"), F.sum("n").alias("n"))
        .where(F.col("n") > 0)
        .select(
            F.col("w.start").alias("window_start"),
            "clz",
            (exact.total(ev, value, F.col("s"), F.col("r")) / F.col("n")).alias("value"),
        )
    )


def series_pivot(result: DataFrame, classes: Sequence[str] = ("low", "mid", "high")) -> DataFrame:
    """Per-class series side by side, one row per window start.

    Classes other than the first ones fold into the last (as the plotter
    does); if several fold together, the largest value is kept.
    """
    classes = list(classes)
    folded = F.when(F.col("clz").isin(classes[:-1]), F.col("clz")).otherwise(F.lit(classes[-1]))
    return (
        result.withColumn("clz", folded)
        .groupBy("window_start")
        .pivot("clz", classes)
        .agg(F.max("value"))
    )
