"""Hard-negative mining by slot-decomposed selection.

Every anchor is scored against all rows, in blocks.  The first pass finds its
positives among the rows of its label.  A positive's window of negative scores
ends at an upper limit; the limits of one anchor's positives cut the scores
into disjoint slots, so a score is looked at once however many windows hold
it.  Combiners keep the best rows of each slot (for a block, then for a group
of blocks, then for all), and a window is answered by merging the slots at and
below its own in descending order, down to its lower limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .knn import _matrix, _top

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95        # percent of the positive's score
SCALE = 256
CHUNK_ANCHORS = 8192      # anchors solved together
BLOCK_ROWS = 16_384       # rows solved together
SCORED = 256              # anchors whose scores with a block are held at a time
LABEL_BUCKETS = 1024      # of the first pass: the bound of its plan
MERGED_BLOCKS = 256       # blocks whose slots are merged before all are


def _grid_rows(scale: int):
    """floor(scale x) of the vectors that take part, as float64 bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for k, (i, label, v) in enumerate(zip(b.column(0), b.column(1), b.column(2))):
                if i.is_valid and label.is_valid and v.is_valid and not v.values.null_count:
                    with np.errstate(over="ignore"):
                        x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    if np.isfinite(x).all():
                        keep.append(k), out.append(x.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in (0, 1, 3)), pa.array(out, pa.binary())], ["vec_id", "label", "rid", "v"])
    return run


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, the earlier of equal ones first."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.argsort(~scores[at], kind="stable")][:k]          # ~s falls as s rises, and never overflows


def _by_id(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.lexsort((t["rid"].to_numpy(), t["vec_id"].to_numpy()))))


def _table(names: tuple[str, ...], parts: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * len(names)
    return pa.table({n: pa.array(np.asarray(c, np.int64)) for n, c in zip(names, columns)})


def _positives(width: int, k: int):
    """Of each anchor the ``k`` best other rows of its label in a block."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        rows = _by_id(rows)
        mine, theirs = anchors["label"].to_numpy(), rows["label"].to_numpy()
        for label in np.intersect1d(mine, theirs):
            x = rows.take(pa.array(np.flatnonzero(theirs == label)))
            ids, rid, data = x["vec_id"].to_numpy(), x["rid"].to_numpy(), _matrix(x["v"], width)
            asked = np.flatnonzero(mine == label)
            for a in range(0, len(asked), SCORED):
                q = anchors.take(pa.array(asked[a:a + SCORED]))
                for own, s in zip(q["rid"].to_numpy(), _top(_matrix(q["v"], width), data)):
                    other = np.flatnonzero(rid != own)
                    at = other[_best(s[other], k)]
                    out.append((np.full(len(at), own), ids[at], rid[at], s[at]))
        return _table(("anchor", "positive_id", "positive", "score"), out)
    return run


def _slots(width: int, k: int):
    """Of each anchor and slot the ``k`` best rows of other labels in a block."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        rows = _by_id(rows)
        ids, theirs, data = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"], width)
        for a in range(0, len(anchors) if len(ids) else 0, SCORED):
            q = anchors.slice(a, SCORED)
            scores = _top(_matrix(q["v"], width), data)
            for own, label, limits, least, s in zip(q["rid"].to_pylist(), q["label"].to_pylist(), q["limits"].to_pylist(), q["least"].to_pylist(), scores):
                edge = np.array(limits, np.int64)                              # upper limits, rising
                at = np.flatnonzero((s >= least) & (s <= edge[-1]) & (theirs != label))
                slot = np.searchsorted(edge, s[at])                            # the first limit that is not below
                for n in np.unique(slot):
                    here = at[slot == n]
                    here = here[_best(s[here], k)]
                    out.append((np.full(len(here), own), np.full(len(here), n), ids[here], s[here]))
        return _table(("anchor", "slot", "negative_id", "negative_score"), out)
    return run


def _first(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def _deal(seed: int, m: Column) -> Column:
    return F.pmod(F.xxhash64("rid", F.lit(seed)), m).cast("int")


def _each(m: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), m - 1))


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score: for each anchor (the rows that ``is_anchor``, a column over
    vec_id, marks) and each of its first ``positives`` other rows of its label,
    the first ``negatives`` rows of other labels whose score is from ``low`` to
    ``high`` percent of the positive's; all, if fewer.  Higher inner products of
    floor(``scale`` x) come first, ties go to the smaller vec_id.

    Rows with a null id, label or vector, or with a null or non-finite
    component, take no part; vectors of different lengths compare on their
    common components (an empty one scores 0).  A positive below 0 has no
    negatives, since its limits cross.  Rows that repeat an id are separate
    rows: each is an anchor, a positive or a negative of its own, and only an
    anchor's own row is not its positive.  Scores beyond a long are limited to
    it.  An empty table gives no rows; other columns are ignored.
    """
    data = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    data = data.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_grid_rows(scale), "vec_id long, label long, rid long, v binary")
    data = written(data, "negatives-rows")
    n, n_anchors, width = data.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max(F.octet_length("v"))).first()
    width = (width or 0) // 8

    # positives: anchors meet the rows of their label's bucket only
    bucket = F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)).cast("int")
    labelled = data.withColumn("bucket", bucket)
    plan = labelled.groupBy("bucket").agg(F.ceil(F.count_if(is_anchor) / CHUNK_ANCHORS).cast("int").alias("chunks"),
                                          F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).where("chunks > 0")
    labelled = labelled.join(F.broadcast(plan), "bucket")                       # at most LABEL_BUCKETS rows
    own = [F.col(c).alias(c) for c in ("rid", "vec_id", "label", "v")]          # both sides come from one table
    of = F.col("bucket").alias("bucket")
    asks = labelled.where(is_anchor).select(of, _deal(1, F.col("chunks")).alias("c"), _each(F.col("blocks")).alias("b"), *own)
    held = labelled.select(of, _each(F.col("chunks")).alias("c"), _deal(2, F.col("blocks")).alias("b"), *own)
    found = asks.groupBy("bucket", "c", "b").cogroup(held.groupBy("bucket", "c", "b")).applyInArrow(
        _positives(width, positives), "anchor long, positive_id long, positive long, score long")
    found = _first(found, ["anchor"], [F.desc("score"), F.asc("positive_id"), F.asc("positive")], positives)

    # limits of the windows, in whole numbers that cannot overflow (no score below 0 has a window)
    whole, rest = F.expr("score div 100"), F.col("score") % 100
    upper = whole * high + F.floor(rest * high / 100)
    lower = whole * low + F.ceil(rest * low / 100)
    windows = written(found.where("score >= 0").select("anchor", "positive_id", F.col("rank").alias("p"), F.col("score").alias("positive_score"),
                                                       upper.alias("upper"), lower.alias("lower")).where("lower <= upper"), "negatives-windows")
    limits = windows.groupBy("anchor").agg(F.array_sort(F.collect_set("upper")).alias("limits"), F.min("lower").alias("least"))

    # negatives: every anchor that has a window meets every row
    chunks, blocks = max(1, -(-n_anchors // CHUNK_ANCHORS)), max(1, -(-n // BLOCK_ROWS))
    asks = data.where(is_anchor).join(limits, F.col("rid") == F.col("anchor")).select(
        _deal(1, F.lit(chunks)).alias("c"), _each(F.lit(blocks)).alias("b"), "rid", "label", "v", "limits", "least")
    held = data.select(_each(F.lit(chunks)).alias("c"), _deal(2, F.lit(blocks)).alias("b"), *own)
    slots = asks.groupBy("c", "b").cogroup(held.groupBy("c", "b")).applyInArrow(
        _slots(width, negatives), "anchor long, slot long, negative_id long, negative_score long")
    best = [F.desc("negative_score"), F.asc("negative_id")]
    if blocks > MERGED_BLOCKS:                     # so that no group holds an entry of every block
        slots = _first(slots.withColumn("part", F.pmod(F.xxhash64("negative_id"), F.lit(-(-blocks // MERGED_BLOCKS)))),
                       ["anchor", "slot", "part"], best, negatives).drop("rank", "part")
    slots = _first(slots, ["anchor", "slot"], best, negatives)

    # at most positives x negatives entries an anchor, best first (~s falls as s rises)
    entry = F.struct(F.bitwise_not("negative_score").alias("down"), F.col("negative_id").alias("id"), F.col("slot").alias("slot"))
    merged = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    slot = F.array_position("limits", F.col("upper")) - 1
    answered = windows.join(limits.select("anchor", "limits"), "anchor").join(merged, "anchor").select(
        "anchor", "p", "positive_id", "positive_score",
        F.slice(F.filter("entries", lambda e: (e["slot"] <= slot) & (F.bitwise_not(e["down"]) >= F.col("lower"))), 1, negatives).alias("kept"))
    names = data.where(is_anchor).select("rid", F.col("vec_id").alias("anchor_id"))
    return answered.join(names, F.col("anchor") == F.col("rid")).select("anchor_id", "positive_id", "positive_score", F.posexplode("kept").alias("at", "e")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("negative_id"), "positive_score",
        F.bitwise_not("e.down").alias("negative_score"))


SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS other_id, q.label = c.label AS same,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), r AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""
