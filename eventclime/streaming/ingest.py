"""One pass over arriving text lines, several outputs.

Every micro-batch is parsed once and written once, each row with its ``kind``:

* ``good``: the typed columns the analysis needs;
* ``late``: rows whose last window had ended at the watermark when they came
  (with the same columns), which a windowed analysis would drop unseen;
* ``rejected``: lines whose shape is wrong, with the field count and a reason.

Beside them one row a micro-batch keeps the watermark and how many rows of
each kind there were.  A micro-batch appears as a whole, by a rename, and a
repeated one that is already there is not written again, so a stream that
reads ``good_rows`` gets each row once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timefmt import event_time
from ..sources import files
from ..sources.text import REASON

GOOD, LATE, REJECTED = "good", "late", "rejected"
LOG = "batch long, watermark timestamp, latest timestamp, good long, late long, rejected long"
_LINE = [T.StructField("line", T.StringType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("reason", T.StringType())]


def seconds(interval: str) -> Column:
    """Length of an interval like ``2 days``."""
    return F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}"))


def last_window_end(ts: Column, size: str, slide: str | None = None) -> Column:
    """End of the last window that holds an instant (epoch seconds); null for
    a null instant.  (``F.window`` would drop rows without an instant.)"""
    at, step = F.unix_seconds(ts), seconds(slide or size)
    return at - F.pmod(at, step) + seconds(size)


def watermark_before(spark: SparkSession, folder: str, k: int, delay: str) -> int:
    """Watermark of micro-batch ``k`` in epoch seconds: the latest event time
    of all before it less the delay (0 at first, as in any stream)."""
    last = f"{folder}/log/batch-{k - 1}"
    if not k or not files.exists(spark, last):
        return 0
    return max(0, spark.read.schema(LOG).parquet(last).agg(F.unix_seconds(F.max("latest")) - F.max(seconds(delay))).first()[0])


def split_batch(parsed: DataFrame, k: int, folder: str, columns: Sequence[str], day_col: str,
                windows: tuple[str, str | None] | None, delay: str) -> None:
    """Write micro-batch ``k`` of parsed lines, with the kind of each, and its
    log row.  Without ``windows`` (size, slide) no row is late."""
    spark = parsed.sparkSession
    target = f"{folder}/rows/batch-{k}"
    if files.exists(spark, target):
        return
    mark = watermark_before(spark, folder, k, delay)
    ts, bad = event_time(F.col(day_col)), F.col(REASON).isNotNull()
    late = F.coalesce(last_window_end(ts, *windows) <= mark, F.lit(False)) if windows else F.lit(False)
    seen = Observation()
    rows = parsed.select(
        *[F.when(~bad, F.col(c)).alias(c) for c in columns], F.when(bad, F.col("_line")).alias("line"),
        F.when(bad, F.col("_n_tokens")).alias("n_tokens"), F.col(REASON).alias("reason"), F.lit(k).cast("long").alias("batch"),
        F.when(bad, REJECTED).when(late, LATE).otherwise(GOOD).alias("kind"), F.when(~bad, F.unix_seconds(ts)).alias("ts__"),
    ).observe(seen, F.max("ts__").alias("latest"), *[F.count_if(F.col("kind") == x).alias(x) for x in (GOOD, LATE, REJECTED)])
    staged = f"{folder}/staged/batch-{k}"
    rows.drop("ts__").write.mode("overwrite").parquet(staged)
    got = seen.get
    # the watermark never goes back, so the latest time before is at least it and the delay
    latest = F.greatest(F.lit(got["latest"]).cast("long"), F.lit(mark) + seconds(delay))
    spark.range(1).select(
        F.lit(k).cast("long").alias("batch"), F.timestamp_seconds(F.lit(mark)).alias("watermark"), F.timestamp_seconds(latest).alias("latest"),
        *[F.lit(got[x]).cast("long").alias(x) for x in (GOOD, LATE, REJECTED)],
    ).write.mode("overwrite").parquet(f"{folder}/log/batch-{k}")
    files.move(spark, staged, target)


def start_ingest(lines: DataFrame, parse: Callable[[DataFrame], DataFrame], folder: str, columns: Sequence[str],
                 day_col: str = "day", windows: tuple[str, str | None] | None = None, delay: str = "0 seconds",
                 trigger: dict | None = None):
    """Start the ingest of a stream of text lines into ``folder`` (its
    checkpoint lies there too); returns the streaming query.

    ``windows`` is the (size, slide) of the analysis whose late rows are to be
    set aside: with one input, exactly those that its own watermark would
    drop.  An analysis of two inputs goes by the slower one's watermark, so
    leave it out there.
    """
    spark = lines.sparkSession
    files.make_folder(spark, f"{folder}/rows")

    def split(batch: DataFrame, k: int) -> None:
        split_batch(batch, k, folder, columns, day_col, windows, delay)

    return (
        parse(lines).writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _read(reader, folder: str, schema: T.StructType, kind: str) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("kind", T.StringType())])
    return reader.schema(full).option("recursiveFileLookup", "true").parquet(f"{folder}/rows").where(F.col("kind") == kind).drop("kind")


def good_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The good rows of an ingest as a stream, in the columns of ``schema``."""
    return _read(spark.readStream, folder, schema, GOOD).drop("batch")


def late_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Rows that came too late, with the micro-batch they came in."""
    return _read(spark.read, folder, schema, LATE)


def rejected_lines(spark: SparkSession, folder: str) -> DataFrame:
    """line, n_tokens, reason, batch of the lines set aside."""
    return _read(spark.read, folder, T.StructType(_LINE), REJECTED)


def ingest_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row a micro-batch: watermark, latest event time, rows of each kind."""
    found = files.names(spark, f"{folder}/log")
    return spark.read.schema(LOG).parquet(*[f"{folder}/log/{n}" for n in found]) if found else spark.createDataFrame([], LOG)
