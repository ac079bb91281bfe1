"""Event-time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_time(day: Column) -> Column:
    """A calendar day as its UTC-midnight timestamp (session zone is UTC)."""
    return day.cast("timestamp")


def render_instant(ts: Column) -> Column:
    """Timestamp as ISO-8601 instant text, e.g. ``2017-02-01T00:00:00Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
