"""Event-time windowed counts and shares.

All of them are single hash aggregations keyed by the window (plus the
country where listed): partial aggregation runs before the shuffle, so a
window or country holding a third of all rows is combined map-side and never
funnels raw rows into one task.  The same code runs on batch DataFrames and
on watermarked streams (one stateful operator, append mode).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import event_time
from .filters import ATTENTION_COUNTRIES, conflict_event, country_in

EVENT_TS = "event_ts"


def with_event_time(events: DataFrame, day_col: str = "day") -> DataFrame:
    """Add the event-time column (UTC midnight of the event day)."""
    if EVENT_TS in events.columns:
        return events
    return events.withColumn(EVENT_TS, event_time(F.col(day_col)))


def _window(size: str, slide: str | None = None):
    w = F.window(EVENT_TS, size) if slide is None else F.window(EVENT_TS, size, slide)
    return w.alias("w")


def count_all(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Events per window (null countries and codes included)."""
    return (
        with_event_time(events)
        .groupBy(_window(size))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "n")
    )


def count_conflict(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Conflict events per window (windows without one emit no row)."""
    return (
        with_event_time(events)
        .where(conflict_event())
        .groupBy(_window(size))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "n")
    )


def count_by_country(
    events: DataFrame, size: str = "2 days", countries: Sequence[str] = ATTENTION_COUNTRIES
) -> DataFrame:
    """Events per (window, listed country)."""
    return (
        with_event_time(events)
        .where(country_in(countries))
        .groupBy(_window(size), F.col("eventGeo_countryCode").alias("country"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "country", "n")
    )


def instability_index(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Conflict events as a percentage of all events, per window.

    One aggregation with a conditional count replaces the join of two
    windowed counts; windows without conflicts emit no row.
    """
    return (
        with_event_time(events)
        .groupBy(_window(size))
        .agg(
            F.count_if(conflict_event()).alias("n_conflict"),
            F.count(F.lit(1)).alias("n_all"),
        )
        .where(F.col("n_conflict") > 0)
        .select(
            F.col("w.start").alias("window_start"),
            (F.col("n_conflict").cast("double") / F.col("n_all") * F.lit(100)).alias("pct"),
        )
    )


def attention_share(
    events: DataFrame, countries: Sequence[str] = ATTENTION_COUNTRIES, size: str = "2 days"
) -> DataFrame:
    """Each listed country's events as a percentage of all events per window.

    One pass: per window, the total and one conditional count per listed
    country; the counts are then unpivoted and zero counts dropped.
    """
    countries = list(dict.fromkeys(countries))
    country = F.col("eventGeo_countryCode")
    counts = [F.count_if(country == F.lit(c)).alias(f"n_{i}") for i, c in enumerate(countries)]
    per_country = F.explode(
        F.array(*[
            F.struct(F.lit(c).alias("country"), F.col(f"n_{i}").alias("n"))
            for i, c in enumerate(countries)
        ])
    ).alias("c")
    return (
        with_event_time(events)
        .groupBy(_window(size))
        .agg(F.count(F.lit(1)).alias("n_all"), *counts)
        .select(F.col("w.start").alias("window_start"), "n_all", per_country)
        .where(F.col("c.n") > 0)
        .select(
            "window_start",
            F.col("c.country").alias("country"),
            (F.col("c.n").cast("double") / F.col("n_all") * F.lit(100)).alias("pct"),
        )
    )
