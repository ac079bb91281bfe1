"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: ASCII white space: the space and 0x09-0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: A key is hot if it holds more than one part in HOT_PARTS of the rows, so
#: there can never be more than HOT_PARTS hot keys: the bound of a broadcast.
HOT_PARTS = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts lineage and survives lost executors; several readers of an expensive
    step share one computation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in the order in which it was
    written: files by name, rows by their place in the file.  A frame that was
    not read from files is numbered by partition, with gaps."""
    try:
        rows = df.select("*", F.col("_metadata.file_name").alias("file__"), F.col("_metadata.row_index").alias("row__"))
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id())
    files = rows.groupBy("file__").agg(F.count(F.lit(1)).alias("n__"))
    # one row a file: as many as the partitions that wrote them
    before = files.select("file__", (F.sum("n__").over(Window.orderBy("file__")) - F.col("n__")).alias("before__"))
    return rows.join(F.broadcast(before), "file__").withColumn(name, F.col("before__") + F.col("row__")).drop("file__", "row__", "before__")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def one_space(text: Column) -> Column:
    """Null becomes empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def fold(doc_id: Column, k: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``k`` (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(k))


def sampled(rate: float, *cols: str) -> Column:
    """True for about ``rate`` (0 to 1) of the rows, by a hash of ``cols``.  A
    threshold of 63 bits: a small rate is not rounded to 0, nor up."""
    top = 2 ** 63
    return F.shiftrightunsigned(F.xxhash64(*cols), 1) <= F.lit(min(top, int(rate * top) + 1) - 1).cast("long")


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column) -> DataFrame:
    """Left join to ``right``, which is unique on ``key`` and holds in
    ``weight`` how many rows of ``left`` have that key.

    Keys with more than 1/HOT_PARTS of the weight are at most HOT_PARTS rows
    and are broadcast; rows of hot keys then take part in the shuffled join
    under a null key dealt by ``spread``, so no key gathers in one task.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = F.lit(total / HOT_PARTS)
    values = [c for c in right.columns if c != key]
    packed = F.struct(*[F.col(c) for c in values])
    hot = right.where(F.col(weight) > limit).select(F.col(key), packed.alias("hot__"))
    cold = right.where(F.col(weight) <= limit).select(
        F.col(key).alias("key__"), F.lit(0).alias("salt__"), packed.alias("cold__"))
    out = left.join(F.broadcast(hot), key, "left")
    is_hot = F.col("hot__").isNotNull()
    out = out.withColumn("probe__", F.when(~is_hot, F.col(key))) \
        .withColumn("deal__", F.when(is_hot | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(10007)).cast("int") + 1).otherwise(0))
    out = out.join(cold, (F.col("probe__") == F.col("key__")) & (F.col("deal__") == F.col("salt__")), "left")
    got = F.coalesce(F.col("hot__"), F.col("cold__"))
    return out.select(*left.columns, *[got[c].alias(c) for c in values])
