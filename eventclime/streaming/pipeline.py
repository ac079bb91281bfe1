"""Structured Streaming versions of the jobs.

The stream operators are the batch operators: the same column expressions and
aggregations run on a watermarked stream in append mode.  What is specific to
streams lives here:

* sources (``readStream`` over parquet or text files, one or more files per
  micro-batch);
* event time and watermarks (0 s out-of-orderness, as in the reference; late
  rows are dropped by Spark's watermark filter);
* closing the last window of bounded input: a literal sentinel row per
  source, later than any date a source can hold, unioned before the
  watermark (a job that goes on later does so on a copy of its checkpoint:
  see ``runner``);
* the nearest-station lookup as a stream-static equi-join with a
  precomputed candidate grid (broadcast, or salted when shuffled) followed
  by a stateless arg-min;
* the event x weather join as a stream-stream join keyed by station and
  day window on both watermarked sides, so its state expires; for the
  averages both sides are aggregated first (chained stateful operators),
  and the row-level join salts its keys so a hot station-day is spread;
* running a query to completion (``availableNow``) into a parquet sink in the
  shared folder and reading the result back as a batch DataFrame.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.classify import DEFAULT_TEMP_RULES, classify
from ..operators.filters import ACTOR_COUNTRY, PROTEST_ROOT_CODE, WEATHER_AFTER, WEATHER_ELEMENT, us_root_event
from ..operators.nearest import StationGrid, fits_broadcast, nearest_from_grid, station_lookup_grid
from ..operators.weather import weather_readings
from ..operators.windows import EVENT_TS, with_event_time
from ..session import scratch_path

# name -> summary of the last run of ``run_to_table`` (rows, rows/s, state rows)
LAST_RUN: dict[str, dict] = {}
WEATHER_TS = "reading_ts"


# ----------------------------------------------------------------- sources

def stream_parquet(spark: SparkSession, folder: str, schema, glob: str | None = None,
                   files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A parquet table (one file, or a folder of part files) as a stream.

    The path is given as a pattern that matches only itself: Spark takes a
    plain path for a folder.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def stream_text(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder)


# --------------------------------------------------------------- sentinels

def sentinel_day():
    """Past every date that a source can hold (years have four digits)."""
    return F.date_add(F.lit(dt.date(9999, 12, 31)), 366)


# Values that pass every event filter of the jobs; other columns stay null.
_SENTINEL_EVENT = {
    "actor1Code_countryCode": ACTOR_COUNTRY, "isRoot": True, "eventRootCode": PROTEST_ROOT_CODE, "quadClass": 4,
    "eventGeo_lat": 0.0, "eventGeo_long": 0.0,
}


def event_sentinel(events: DataFrame, actor_country: str = ACTOR_COUNTRY) -> DataFrame:
    """One literal event (nothing is read) on the sentinel day that passes the
    jobs' filters, in the columns of ``events``."""
    values = _SENTINEL_EVENT | {"actor1Code_countryCode": actor_country}
    return events.sparkSession.range(1).select(*[
        (sentinel_day() if f.name == "day" else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name)
        for f in events.schema.fields if f.name != EVENT_TS
    ])


def write_sentinel(spark: SparkSession, rows: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    rows.write.mode("overwrite").parquet(path)
    return path


def with_watermark(df: DataFrame, ts: str, delay: str = "0 seconds") -> DataFrame:
    return df.withWatermark(ts, delay)


# ----------------------------------------------------------------- running

def run_to_table(spark: SparkSession, result: DataFrame, name: str, mode: str = "append",
                 timeout_s: int | None = None, out: str | None = None, ckpt: str | None = None) -> DataFrame:
    """Run a streaming query to completion (``availableNow``) into a parquet
    table under the shared folder; return that table as a batch DataFrame.
    ``out`` and ``ckpt`` continue an earlier run.

    The checkpoint serves this bounded run only, so its state has one
    partition per core, at most the session's shuffle setting.
    """
    out = out or scratch_path(spark, f"{name}-out")
    ckpt = ckpt or scratch_path(spark, f"{name}-ckpt")
    writer = (
        result.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", ckpt).outputMode(mode)
        .trigger(availableNow=True)
    )
    q = start_with_state_partitions(spark, writer, bounded_partitions(spark))
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"streaming query {name} did not finish")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    LAST_RUN[name] = _summary(q.recentProgress)
    return spark.read.schema(result.schema).parquet(out)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_partitions(spark: SparkSession) -> int:
    """State partitions of a bounded run: one per core, at most the session's
    shuffle setting."""
    return min(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)


def start_with_state_partitions(spark: SparkSession, writer, partitions: int | None = None):
    """Start a streaming query whose state is split into ``partitions``.

    A stateful query fixes its state partition count when it first starts, for
    the life of its checkpoint; the default is the session's shuffle setting.
    Every state partition is a state store opened and committed per
    micro-batch, so small runs want few.  Another number is set on the
    session during the start only; don't start two queries of one session at
    the same time with different numbers.
    """
    key = "spark.sql.shuffle.partitions"
    current = spark.conf.get(key)
    if partitions is None or partitions == int(current):
        return writer.start()
    spark.conf.set(key, str(partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, current)


def closing_stream(spark: SparkSession, schema, folder: str) -> DataFrame:
    """Stream over a folder (made here, empty) that a closing pass puts a
    sentinel row into: see ``runner``."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def _summary(progress: list[dict]) -> dict:
    rows = sum(p.get("numInputRows", 0) for p in progress)
    busy = sum(p.get("durationMs", {}).get("triggerExecution", 0) for p in progress) / 1000.0
    last = progress[-1] if progress else {}
    state = sum(op.get("numRowsTotal", 0) for op in last.get("stateOperators", []))
    return {
        "durations_ms": [p.get("durationMs", {}) for p in progress],
        "input_rows": rows,
        "batches": len(progress),
        "rows_per_sec": round(rows / busy, 1) if busy else None,
        "state_rows_at_end": state,
    }


# ------------------------------------------------------------------ joins

def located_event_stream(
    events: DataFrame,
    grid: StationGrid,
    extra_filter=None,
    actor_country: str = ACTOR_COUNTRY,
    broadcast_grid: bool | None = None,
) -> DataFrame:
    """US root events with their nearest station (stateless per row).

    The grid is broadcast when its checked bytes allow; otherwise the
    stream-static join shuffles both sides on the cell plus a salt (streaming
    runs without adaptive skew handling), so a hot cell is spread over half
    the session's shuffle partitions.
    """
    ev = events.where(us_root_event(actor_country))
    if extra_filter is not None:
        ev = ev.where(extra_filter)
    if broadcast_grid is None:
        broadcast_grid = fits_broadcast(grid)
    salt = 1 if broadcast_grid else max(2, shuffle_partitions(ev.sparkSession) // 2)
    return nearest_from_grid(ev, grid, broadcast=broadcast_grid, salt=salt)


def stream_event_weather(
    events: DataFrame,
    readings: DataFrame,
    value: str = "avgTone",
    salt: int | None = None,
) -> DataFrame:
    """Stream-stream inner join of located events and readings on (station,
    day window); both inputs carry a 0 s watermark, so join state expires as
    event time passes.

    The output is one row per event, so event rows are kept in join state.
    To keep a station-day that holds a third of all events off a single
    state partition, events carry a salt (a hash of their id, so a retried
    task assigns the same one) and each reading is replicated once per salt
    value.  If not given, that is the square root of a bounded run's state
    partitions: more copies of every reading would cost more than a smaller
    share of one station-day saves, and with a salt for every other partition
    each would hold half of all readings, however many there are.

    The station is compared null-safe, with readings that have one: a plain
    equality implies that the event's station is not null, and Spark would
    compute all distances once more to see that.
    """
    salt = salt or max(2, math.ceil(math.sqrt(bounded_partitions(events.sparkSession))))
    ev = events.select(
        "globalEventID", F.col(value).alias("value"), "station_id",
        F.window(EVENT_TS, "1 day").alias("ew"),
        F.pmod(F.xxhash64("globalEventID"), F.lit(salt)).cast("int").alias("_es"),
    )
    rd = readings.where(F.col("id").isNotNull()).select(
        "id", "temp", F.window(WEATHER_TS, "1 day").alias("rw"),
        F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_rs"),
    )
    cond = F.col("station_id").eqNullSafe(F.col("id")) & (F.col("ew") == F.col("rw")) & (F.col("_es") == F.col("_rs"))
    return ev.join(rd, cond).drop("_es", "_rs")


def stream_avg_by_weather_class(
    located: DataFrame,
    readings: DataFrame,
    value: str = "avgTone",
    rules=DEFAULT_TEMP_RULES,
    size: str = "1 day",
    slide: str | None = None,
) -> DataFrame:
    """Average ``value`` per (window, class of the station-day's reading).

    The stream mirrors the batch plan with chained stateful operators:
    events -> (station, day) sum and count, readings -> (station, day, class)
    multiplicity, a stream-stream join of the two on (station, day window),
    then the windowed sum per class, re-windowed with ``window_time``.  Join
    state holds one row per station-day and class, never raw events, so a
    station-day holding a third of the events is one state row.
    """
    whole, rest = exact.terms(located, value)
    ev = located.groupBy("station_id", F.window(EVENT_TS, "1 day").alias("ew")).agg(
        F.sum(whole).alias("s"), F.sum(rest).alias("r"), F.count(value).alias("n")
    )
    rd = (
        readings.withColumn("clz", classify(F.col("temp"), rules))
        .where(F.col("clz").isNotNull())
        .groupBy("id", F.window(WEATHER_TS, "1 day").alias("rw"), "clz")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    joined = ev.join(rd, (F.col("station_id") == F.col("id")) & (F.col("ew") == F.col("rw")))
    t = F.window_time("ew")
    w = F.window(t, size) if slide is None else F.window(t, size, slide)
    return (
        joined.groupBy(w.alias("w"), "clz")
        .agg(
            F.sum(F.col("s") * F.col("copies")).alias("s"),
            F.sum(F.col("r") * F.col("copies")).alias("r"),
            F.sum(F.col("n") * F.col("copies")).alias("n"),
        )
        .where(F.col("n") > 0)
        .select(F.col("w.start").alias("window_start"), "clz", (exact.total(located, value, F.col("s"), F.col("r")) / F.col("n")).alias("value"))
    )


def weather_stream_readings(
    weather: DataFrame, element: str = WEATHER_ELEMENT, after=WEATHER_AFTER
) -> DataFrame:
    rd = weather_readings(weather, element, after)
    return rd.withColumn(WEATHER_TS, F.col("date").cast("timestamp"))


def readings_of_grid(readings: DataFrame, grid: StationGrid) -> DataFrame:
    """Readings (watermarked) of the stations that the grid can name; no other
    station's can meet a located event, so they need not be kept for one.

    An inner join with distinct ids stays above the watermark, where a filter
    would not: all readings, the sentinel too, move event time.
    """
    ids = grid.cells.select(F.explode("cands.id").alias("id")).distinct()
    return readings.join(F.broadcast(ids) if fits_broadcast(grid) else ids, "id")


def reading_sentinel(weather: DataFrame, element: str = WEATHER_ELEMENT) -> DataFrame:
    """One literal reading on the sentinel day that passes the jobs' filters,
    in the columns of ``weather``.  Its station id is no station's."""
    values = {"id": F.lit(""), "date": sentinel_day(), "element": F.lit(element), "datavalue": F.lit("0")}
    return weather.sparkSession.range(1).select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in weather.schema.fields
    ])


__all__ = [
    "stream_parquet", "stream_text", "event_sentinel", "write_sentinel", "with_watermark",
    "run_to_table", "stream_table", "closing_stream", "station_lookup_grid", "located_event_stream", "stream_event_weather",
    "stream_avg_by_weather_class", "weather_stream_readings", "readings_of_grid", "reading_sentinel",
    "with_event_time", "nearest_from_grid",
]
