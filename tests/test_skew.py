"""The row-level weather join with a station-day that holds a third of the events."""

import collections
import datetime as dt
import statistics

from pyspark.sql import functions as F

from eventclime.operators import weather

ROWS = 120_000
STATIONS = 40
DAYS = 25


def test_hot_station_day_is_split(spark):
    """Without broadcasts, adaptive execution cuts the hot station-day: the
    plan says so, no task reads more than twice the median, no row is lost."""
    stations = spark.createDataFrame(
        [(f"USC{i:08d}", 25.0 + i / 2, -120.0 + i, i) for i in range(STATIONS)], "id string, latitude double, longitude double, ord long")
    days = [dt.date(2017, 3, 1) + dt.timedelta(days=k) for k in range(DAYS)]
    readings = spark.createDataFrame(
        [(f"USC{i:08d}", d, "TMAX", str(10 * i + k)) for i in range(STATIONS) for k, d in enumerate(days)],
        "id string, date date, element string, datavalue string")
    hot = F.col("id") % 3 == 0
    key = F.when(hot, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(STATIONS * DAYS))).cast("int")
    events = spark.range(ROWS, numPartitions=16).select(
        F.col("id").alias("globalEventID"), F.date_add(F.lit(days[0]), (key % DAYS).cast("int")).alias("day"),
        F.lit("USA").alias("actor1Code_countryCode"), F.lit(True).alias("isRoot"), F.rand(3).alias("avgTone"),
        (25.0 + F.floor(key / DAYS) / 2).alias("eventGeo_lat"), (-120.0 + F.floor(key / DAYS)).cast("double").alias("eventGeo_long"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",      # as the data are small
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2.0",
        "spark.sql.shuffle.partitions": "12",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = weather.event_weather_join(events, readings, stations).select("globalEventID", F.spark_partition_id().alias("task"))
        rows = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == len({r.globalEventID for r in rows}) == ROWS
    assert "skew=true" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    sizes = sorted(collections.Counter(r.task for r in rows).values())
    hot_tasks = {r.task for r in rows if r.globalEventID % 3 == 0}
    print(sizes, len(hot_tasks))
    assert len(hot_tasks) > 2 and sizes[-1] <= 2 * statistics.median(sizes)
