"""Text sources: event TSV, weather CSV, station list.

Lines are read with the text source and split with ``split(line, sep, -1)``
(trailing empty fields are kept, so the token count is the real field
count).  Every token is typed with a null-on-error expression; rows whose
shape is wrong go to a reject table with the raw line and a reason instead of
failing the job.  Works unchanged on ``spark.readStream.text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import parse_double, parse_token, parse_yyyymmdd
from ..schemas import EVENT_COLUMNS, EVENT_TOKENS

REASON = "_reject_reason"


# ------------------------------------------------------------------- lines

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, ended by a line feed only: a carriage return inside a
    field does not end the record (the parsers strip a trailing one)."""
    return spark.read.option("lineSep", "\n").text(path)


def strip_cr(line: Column) -> Column:
    """The line without one trailing carriage return."""
    return F.when(line.endswith("\r"), F.left(line, F.length(line) - F.lit(1))).otherwise(line)


# ------------------------------------------------------------------ events

def parse_event_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Raw lines -> typed event columns plus ``_n_tokens`` and the reject
    reason (null for a good row).

    A row must have 58 fields, or 57 when only the source URL is missing,
    and a valid ``day``.
    """
    line = strip_cr(F.col(line_col))
    toks = F.split(line, "\t", -1)
    n = F.size(toks)
    typed = [parse_token(F.get(toks, i), typ).alias(name) for i, (name, typ) in enumerate(EVENT_COLUMNS)]
    reason = (
        F.when(~F.col("_n_tokens").isin(EVENT_TOKENS, EVENT_TOKENS - 1), F.lit("token_count"))
        .when(F.col("day").isNull(), F.lit("bad_day"))
    )
    return (
        lines.select(line.alias("_line"), n.alias("_n_tokens"), *typed)
        .withColumn(REASON, reason)
    )


def valid_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(REASON).isNull()).drop("_line", "_n_tokens", REASON)


def reject_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col(REASON).isNotNull()).select(
        F.col("_line").alias("line"), F.col("_n_tokens").alias("n_tokens"), F.col(REASON).alias("reason")
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event TSV files (no header, no quoting) -> typed events."""
    return valid_rows(parse_event_lines(read_lines(spark, path)))


def read_event_rejects(spark: SparkSession, path: str) -> DataFrame:
    return reject_rows(parse_event_lines(read_lines(spark, path)))


def event_struct_view(events: DataFrame) -> DataFrame:
    """Nest the flat ``group_child`` columns into one struct per group."""
    from ..schemas import GROUPS

    out = events
    for group, fields in GROUPS.items():
        present = [f"{group}_{c}" for c, _ in fields if f"{group}_{c}" in events.columns]
        if not present:
            continue
        out = out.withColumn(
            group, F.struct(*[F.col(f"{group}_{c}").alias(c) for c, _ in fields if f"{group}_{c}" in present])
        ).drop(*present)
    return out


def flatten_struct_view(events: DataFrame) -> DataFrame:
    """Inverse of ``event_struct_view``."""
    from ..schemas import GROUPS

    cols = []
    for name, typ in events.dtypes:
        if name in GROUPS and typ.startswith("struct"):
            cols += [F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in events.select(f"{name}.*").columns]
        else:
            cols.append(F.col(name))
    return events.select(*cols)


# ----------------------------------------------------------------- weather

def parse_weather_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Comma-separated readings: the first four fields (id, yyyyMMdd date,
    element, value text) are used, any further fields are ignored."""
    line = strip_cr(F.col(line_col))
    toks = F.split(line, ",", -1)
    n = F.size(toks)
    reason = (
        F.when(F.col("_n_tokens") < 4, F.lit("token_count"))
        .when(F.col("date").isNull(), F.lit("bad_date"))
    )
    return lines.select(
        line.alias("_line"),
        n.alias("_n_tokens"),
        F.get(toks, 0).alias("id"),
        parse_yyyymmdd(F.get(toks, 1)).alias("date"),
        F.get(toks, 2).alias("element"),
        F.get(toks, 3).alias("datavalue"),
    ).withColumn(REASON, reason)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    return valid_rows(parse_weather_lines(read_lines(spark, path)))


def read_weather_rejects(spark: SparkSession, path: str) -> DataFrame:
    return reject_rows(parse_weather_lines(read_lines(spark, path)))


# ---------------------------------------------------------------- stations

def parse_station_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Blank-separated id, latitude, longitude, then free text.

    ``ord`` keeps the catalogue order (file, block, position), which breaks
    distance ties in the nearest-station search.
    """
    line = strip_cr(F.col(line_col))
    toks = F.split(line, " +", -1)
    lat, lon = parse_double(F.get(toks, 1)), parse_double(F.get(toks, 2))
    reason = F.when(F.col("_n_tokens") < 3, F.lit("token_count")).when(
        F.col("latitude").isNull() | F.col("longitude").isNull(), F.lit("bad_coordinate")
    )
    return lines.select(
        line.alias("_line"),
        F.size(toks).alias("_n_tokens"),
        F.get(toks, 0).alias("id"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
        ).alias("ord"),
    ).withColumn(REASON, reason)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    return valid_rows(parse_station_lines(read_lines(spark, path)))


def read_station_rejects(spark: SparkSession, path: str) -> DataFrame:
    return reject_rows(parse_station_lines(read_lines(spark, path)))
