"""Connected components of a large edge list by alternating star contraction.

Each round links every node's larger neighbours to its smallest neighbour
(large star), then every node's smaller neighbours to the smallest of them
(small star), until the edge list is a forest of stars.  The number of rounds
grows with the logarithm of the longest chain, not with its length.  A node
with very many neighbours is handled by ``join_unique``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, written


def _star(edges: DataFrame) -> DataFrame:
    """(u, v, m): each directed edge with the smallest of u's neighbours."""
    mins = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg__"))
    return join_unique(edges, written(mins, "star-min"), "u", "deg__", F.col("v")).drop("deg__")


def _print(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b, any order);
    ``root`` is the smallest node of the component."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = _print(e)
    while seen[0]:
        both = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both-ways")
        large = _star(both).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large-star")
        down = _star(large)
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = written(small, "small-star")
        now = _print(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
