"""Result CSV sinks, for batches and for streams, and their reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefmt import render_instant
from ..schemas import RESULT_SCHEMA
from . import files


def result_rows(result: DataFrame) -> DataFrame:
    """window_start rendered as ISO text, then every other column in order."""
    others = [F.col(c) for c in result.columns if c != "window_start"]
    return result.select(render_instant(F.col("window_start")).alias("window_start"), *others)


def write_result_csv(result: DataFrame, path: str, single_file: bool = True) -> str:
    """Overwrite ``path`` with the result as header-less CSV.

    ``single_file`` gathers the rows into one part file; results are one row
    per window and key, so this is small whatever the input size.  They get there by an
    exchange, so that the aggregation before it keeps its own partitions.
    """
    out = result_rows(result)
    if single_file:
        out = out.repartition(1)
    out.write.mode("overwrite").option("header", "false").csv(path)
    return path


def read_result_csv(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """Read a result CSV back (window_start text, class, value)."""
    return spark.read.schema(schema).option("header", "false").csv(path)


# ------------------------------------------------- one file for a stream job
#
# A stream's result rows are kept by micro-batch under ``folder``:
#
#   batch=<k>    the rows that micro-batch k added (written again, whole, when
#                the micro-batch is repeated after a failure)
#   upto=<k>     the rows of all micro-batches up to k, once they were folded
#   open         what the windows that are not complete yet would give if the
#                input ended now (written anew by every closing pass)
#
# and published from there as one CSV file that replaces the one before.

FOLD = 50    # micro-batches kept apart before they are folded into one


def _number(name: str) -> int:
    return int(name.split("=")[1])


def _held(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """(folders that hold the result, folders that a fold has replaced)."""
    found = files.names(spark, folder)
    folded = max((_number(n) for n in found if n.startswith("upto=")), default=-1)
    now, old = ([f"upto={folded}"] if folded >= 0 else []), []
    for n in found:
        if n.startswith("batch="):
            (now if _number(n) > folded else old).append(n)
        elif n.startswith("upto=") and _number(n) < folded:
            old.append(n)
    return now, old


def add_batch(rows: DataFrame, k: int, folder: str) -> None:
    """Keep the rows of micro-batch ``k``, replacing those of an earlier try."""
    spark = rows.sparkSession
    if _fold_due(spark, folder):
        _fold(spark, rows.schema, folder)
    staged = f"{folder}-staged/batch={k}"
    rows.write.mode("overwrite").parquet(staged)
    files.replace(spark, staged, f"{folder}/batch={k}")


def _fold_due(spark: SparkSession, folder: str) -> bool:
    return sum(n.startswith("batch=") for n in _held(spark, folder)[0]) >= FOLD


def _fold(spark: SparkSession, schema, folder: str) -> None:
    """Called before a micro-batch is added, when all held ones are committed
    but perhaps the last, which stays apart."""
    now, _ = _held(spark, folder)
    batches = sorted((n for n in now if n.startswith("batch=")), key=_number)[:-1]
    past = [n for n in now if n.startswith("upto=")] + batches
    last = _number(batches[-1])
    staged = f"{folder}-staged/upto={last}"
    spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in past]).coalesce(1).write.mode("overwrite").parquet(staged)
    files.replace(spark, staged, f"{folder}/upto={last}")
    for n in _held(spark, folder)[1]:
        files.remove(spark, f"{folder}/{n}")


def set_open(rows: DataFrame, folder: str) -> None:
    """Replace the rows of the windows that are not complete yet."""
    staged = f"{folder}-staged/open"
    rows.write.mode("overwrite").parquet(staged)
    files.replace(rows.sparkSession, staged, f"{folder}/open")


def held_result(spark: SparkSession, schema, folder: str) -> DataFrame:
    """All rows of a stream job so far, those of open windows included."""
    now = _held(spark, folder)[0] + ([n for n in files.names(spark, folder) if n == "open"])
    if not now:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in now])


def publish(spark: SparkSession, schema, folder: str, path: str) -> str:
    """Write the whole result as one header-less CSV file in ``path``, in the
    order of the windows.  The rows are one a window and key, however large
    the input; the file of the last time stays until the new one is whole."""
    rows = held_result(spark, schema, folder)
    staged = f"{folder}-staged/csv"
    result_rows(rows.repartition(1).sortWithinPartitions(*rows.columns)).write.mode("overwrite").option("header", "false").csv(staged)
    files.replace(spark, staged, path)
    return path
