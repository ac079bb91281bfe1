"""Derived test views over the driver's tables.

The driver's tables carry no coordinates, event codes or weather; these views
derive them from keys with integer arithmetic so the same rows can be produced
by an independent SQL engine.  They are the inputs of every registered query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(c, m: int):
    return F.pmod(c, F.lit(m))


def fx_event(events: DataFrame) -> DataFrame:
    """Events table -> event records in the canonical column names."""
    eid, uid = F.col("event_id"), F.col("user_id")
    actor1 = (
        F.when(_mod(uid, 5) == 0, F.lit(None).cast("string"))
        .when(_mod(uid, 5) == 1, F.lit("GBR"))
        .otherwise(F.lit("USA"))
    )
    root = F.when(_mod(eid, 23) == 22, F.lit(None).cast("string")).otherwise(
        F.lpad((F.lit(1) + _mod(eid, 20)).cast("string"), 2, "0")
    )
    quad = F.when(_mod(eid, 29) == 28, F.lit(None)).otherwise(F.lit(1) + _mod(eid, 4))
    geo_country = (
        F.when(_mod(uid, 9) == 0, F.lit(None).cast("string"))
        .when(_mod(uid, 9) == 1, F.lit("UK"))
        .when(_mod(uid, 9) == 2, F.lit("NK"))
        .when(_mod(uid, 9) == 3, F.lit("CH"))
        .when(_mod(uid, 9) == 4, F.lit("IN"))
        .when(_mod(uid, 9) == 5, F.lit("BR"))
        .when(_mod(uid, 9) == 6, F.lit("FR"))
        .otherwise(F.lit("US"))
    )
    lat = F.when(_mod(eid, 31) == 30, F.lit(None).cast("double")).otherwise(
        (F.lit(25) + _mod(uid * 7919, 24)).cast("double") + F.lit(1.0) / F.lit(8.0)
    )
    lon = (F.lit(-124) + _mod(uid * 104729, 57)).cast("double") + F.lit(1.0) / F.lit(8.0)
    return events.select(
        eid.alias("globalEventID"),
        F.to_date(F.col("ts")).alias("day"),
        actor1.alias("actor1Code_countryCode"),
        (_mod(eid, 4) != 3).alias("isRoot"),
        root.alias("eventRootCode"),
        quad.cast("int").alias("quadClass"),
        (F.lit(1) + _mod(eid, 17)).cast("int").alias("numMentions"),
        (F.col("value") / F.lit(10.0) - F.lit(5.0)).alias("avgTone"),
        geo_country.alias("eventGeo_countryCode"),
        lat.alias("eventGeo_lat"),
        lon.alias("eventGeo_long"),
    )


def fx_station(supplier: DataFrame) -> DataFrame:
    """Supplier table -> station catalogue (id, latitude, longitude, ord)."""
    k = F.col("s_suppkey")
    prefix = F.when(_mod(k, 4) == 0, F.lit("USW")).otherwise(F.lit("USC"))
    lat = (F.lit(25) + _mod(k * 6007, 24)).cast("double") + _mod(k, 7).cast("double") / F.lit(16.0)
    lon = (F.lit(-124) + _mod(k * 7907, 57)).cast("double") + _mod(k, 5).cast("double") / F.lit(16.0)
    return supplier.select(
        F.concat(prefix, F.lpad(k.cast("string"), 8, "0")).alias("id"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        k.cast("long").alias("ord"),
    )


def fx_weather(events: DataFrame, stations: DataFrame) -> DataFrame:
    """Daily readings (TMAX, TMIN, PRCP) for every station on every event day,
    with deterministic gaps.

    Each station expands its own day range (a generator, no cross join); a
    semi join keeps only days that carry events.
    """
    days = events.select(F.to_date(F.col("ts")).alias("date")).distinct()
    bounds = days.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    per_day = stations.select(
        "id", "ord",
        F.explode(F.sequence(bounds["lo"], bounds["hi"], F.expr("INTERVAL 1 DAY"))).alias("date"),
    ).join(days, "date", "left_semi")
    elements = F.array(
        F.struct(F.lit("TMAX").alias("element"), F.lit(0).alias("k")),
        F.struct(F.lit("TMIN").alias("element"), F.lit(1).alias("k")),
        F.struct(F.lit("PRCP").alias("element"), F.lit(2).alias("k")),
    )
    dom = F.dayofmonth("date")
    return (
        per_day.where(_mod(F.col("ord") + dom, 11) != 0)
        .select("id", "ord", "date", F.explode(elements).alias("e"))
        .select(
            "id",
            "date",
            F.col("e.element").alias("element"),
            (
                _mod(F.col("ord") * 31 + dom * 17 + F.col("e.k") * 7, 450) - F.lit(100)
            ).cast("string").alias("datavalue"),
        )
    )


def load_fixture(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three derived views for a scale-factor folder."""
    events = read_table(spark, sf_dir, "events")
    stations = fx_station(read_table(spark, sf_dir, "supplier"))
    return {
        "events": fx_event(events),
        "stations": stations,
        "weather": fx_weather(events, stations),
    }


# The same views as SQL text (runs unchanged in Spark SQL and DuckDB); used
# by the oracle queries.
FX_EVENT_SQL = """
SELECT event_id AS globalEventID, CAST(date_trunc('day', ts) AS DATE) AS day,
 CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN 'GBR' ELSE 'USA' END AS actor1Code_countryCode,
 (event_id % 4 <> 3) AS isRoot,
 CASE WHEN event_id % 23 = 22 THEN NULL ELSE lpad(CAST(1 + event_id % 20 AS VARCHAR), 2, '0') END AS eventRootCode,
 CAST(CASE WHEN event_id % 29 = 28 THEN NULL ELSE 1 + event_id % 4 END AS INTEGER) AS quadClass,
 CAST(1 + event_id % 17 AS INTEGER) AS numMentions,
 value / CAST(10 AS DOUBLE) - CAST(5 AS DOUBLE) AS avgTone,
 CASE user_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'UK' WHEN 2 THEN 'NK' WHEN 3 THEN 'CH' WHEN 4 THEN 'IN'
      WHEN 5 THEN 'BR' WHEN 6 THEN 'FR' ELSE 'US' END AS eventGeo_countryCode,
 CASE WHEN event_id % 31 = 30 THEN NULL
      ELSE CAST(25 + (user_id * 7919) % 24 AS DOUBLE) + CAST(1 AS DOUBLE) / 8 END AS eventGeo_lat,
 CAST(-124 + (user_id * 104729) % 57 AS DOUBLE) + CAST(1 AS DOUBLE) / 8 AS eventGeo_long
FROM events
"""

FX_STATION_SQL = """
SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'USW' ELSE 'USC' END || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id,
 CAST(25 + (s_suppkey * 6007) % 24 AS DOUBLE) + CAST(s_suppkey % 7 AS DOUBLE) / 16 AS latitude,
 CAST(-124 + (s_suppkey * 7907) % 57 AS DOUBLE) + CAST(s_suppkey % 5 AS DOUBLE) / 16 AS longitude,
 CAST(s_suppkey AS BIGINT) AS ord
FROM supplier
"""

FX_WEATHER_SQL = """
SELECT s.id AS id, d.day AS date, e.element AS element,
 CAST((s.ord * 31 + day(d.day) * 17 + e.k * 7) % 450 - 100 AS VARCHAR) AS datavalue
FROM fx_station s
CROSS JOIN (SELECT DISTINCT CAST(date_trunc('day', ts) AS DATE) AS day FROM events) d
CROSS JOIN (SELECT 'TMAX' AS element, 0 AS k UNION ALL SELECT 'TMIN', 1 UNION ALL SELECT 'PRCP', 2) e
WHERE (s.ord + day(d.day)) % 11 <> 0
"""


def oracle_with(body: str, ctes: str = "") -> str:
    """Prefix an oracle query with the three fixture views (and optional
    further ``name AS (...)`` definitions) as CTEs."""
    extra = ",\n" + ctes.strip().rstrip(",") if ctes.strip() else ""
    return (
        "WITH fx_event AS (" + FX_EVENT_SQL + "),\n"
        "fx_station AS (" + FX_STATION_SQL + "),\n"
        "fx_weather AS (" + FX_WEATHER_SQL + ")" + extra + "\n" + body
    )
