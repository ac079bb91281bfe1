"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups.

``classes`` groups on (hash, normalised text): the 128-bit hash keeps the
comparison cheap and the text itself in the grouping key means that two texts
only share a class if their bytes are equal, so a hash collision splits.
Copies collapse in the map tasks (a group of any size is one row per task
before the shuffle).  The second step joins each document to its class on the
hash alone; classes of colliding hashes (normally none) are joined on the
hash and the text.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_unique, one_space, written


def content_hash(text: Column) -> Column:
    """128-bit hash of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalise: Callable[[Column], Column] = one_space,
                hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group.  ``keep_id`` is
    the smallest non-null id of the group (null if it has none).  Rows that
    repeat the smallest id are the same document and are all kept; a row with
    a null id is kept only if its whole group has null ids.  An empty table
    gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("t"))
    texts = texts.select("doc_id", hash_fn(F.col("t")).alias("h"), "t")

    by_text = texts.groupBy("h", "t").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    colliding = written(
        by_text.select("h", "keep_id", "group_size", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha")),
        "exact-classes")
    per_hash = colliding.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"), F.min("sha").alias("sha"))
    single = written(per_hash, "exact-hashes")

    shared = single.where("n > 1").select("h")
    plain = join_unique(texts.select("doc_id", "h"), single, "h", "group_size", F.col("doc_id"))
    if shared.isEmpty():
        return _result(plain)
    again = texts.join(shared, "h", "left_semi")
    exact = again.groupBy("h", "t").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")) \
        .withColumn("sha", F.unhex(F.sha2(F.col("t").cast("binary"), 256))) \
        .withColumn("ht", F.struct("h", "t")).drop("h", "t")
    apart = join_unique(again.select("doc_id", F.struct("h", "t").alias("ht")), exact, "ht", "group_size", F.col("doc_id"))
    return _result(plain.where("n = 1")).unionByName(_result(apart))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
