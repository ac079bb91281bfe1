"""Mixing sources to target weights by Pfair scheduling.

The j-th block (from 0) of a source with weight w (a share of 1) is released
at slot floor(j/w) and due by slot ceil((j+1)/w); earliest deadline first gives
every slot to the released block that is due first, and since the weights fill
every slot each block meets its window, so after any number of slots each
source is less than one block from its target.  Windows come from the exact
weights (integers with a sum of at most ``UNIT``), not from a rounded period.

The slots are cut into laps.  One pass over the laps fixes how many blocks of
each source lie before a lap's end: those due by then, and, of the blocks whose
window spans the end, as many as there are free slots.  They are taken by
deadline; one is taken only if it still finds a free slot after its release
(blocks parked at the first free slot from their release occupy the same slots
in any order, so this is the greedy choice in a matroid: no set of blocks that
fits the lap leaves fewer urgent ones to the next).  The pass holds one lap and
no documents; the laps are then scheduled independently, in parallel.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

UNIT = 1 << 42          # the integer weights' sum is at most this (and one for each source)
LAP_SLOTS = 100_000     # slots of a lap, or 16 for each source if that is more
MAX_LAP = 1 << 20       # a lap's products stay below 2**63
MAX_TASKS = 4096        # tasks that schedule laps
MAX_SOURCES = 1_000_000  # sources with a weight: the bound of what is broadcast
BLOCK_DOCS = 4          # documents of a block
TEMPERATURE = 0.7       # default weights: share of documents to this power
RANGE_DOCS = 5_000      # documents of a source that one window numbers, about
RANGE_BITS = 32         # up to so many ranges (2**32)


def integer_weights(weights: list[float]) -> list[int]:
    """Positive weights as integers of the same ratios: exactly the decimal
    numbers given if their integers' sum is at most ``UNIT``, else to
    1/``UNIT`` (after 10**9 slots, less than a thousandth of a block)."""
    exact = [Fraction(str(w)) for w in weights]
    scale = math.lcm(*{w.denominator for w in exact})
    total = sum(exact)
    if total * scale <= UNIT:
        return [int(w * scale) for w in exact]
    return [max(1, round(w / total * UNIT)) for w in exact]


def lap_end(weights: list[int], before: list[int], t0: int, t1: int) -> list[int]:
    """Blocks of each source before slot ``t1``, given those before ``t0``."""
    total = sum(weights)
    fixed, releases, spanning = [], [], []
    for s, (w, n) in enumerate(zip(weights, before)):
        due = max(n, w * t1 // total)
        fixed.append(due)
        if due > n:
            first, rest = divmod(n * total, w)
            releases.append(first + (rest + np.arange(due - n, dtype="int64") * total) // w)
        if due * total < w * t1:      # released before the end, due after it
            spanning.append((-(-(due + 1) * total // w), s, max(t0, due * total // w)))
    taken = np.zeros(t1 - t0, dtype=bool)
    if releases:
        r = np.sort(np.maximum(np.concatenate(releases) - t0, 0))
        i = np.arange(len(r))
        taken[np.maximum.accumulate(r - i) + i] = True
    free = np.flatnonzero(~taken)
    follow = list(range(len(free) + 1))      # the first free slot at or after, by path halving
    left = len(free)
    for _, s, release in sorted(spanning):
        if left == 0:
            break
        k = int(np.searchsorted(free, release - t0))
        while follow[k] != k:
            follow[k] = follow[follow[k]]
            k = follow[k]
        if k < len(free):
            follow[k] = k + 1
            fixed[s] += 1
            left -= 1
    if left:
        raise AssertionError("a slot stays free")
    return fixed


def lap_slots(weights: list[int], before: list[int], after: list[int], t0: int, t1: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, slot) of a lap's slots, by earliest
    deadline first."""
    total = sum(weights)
    jobs = sorted((n * total // weights[s], s, n) for s, (a, b) in enumerate(zip(before, after)) for n in range(a, b))
    ready: list[tuple[int, int, int, int]] = []
    k = 0
    for slot in range(t0, t1):
        while k < len(jobs) and jobs[k][0] <= slot:
            release, s, n = jobs[k]
            heapq.heappush(ready, (-(-(n + 1) * total // weights[s]), s, n, release))
            k += 1
        due, s, n, release = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a block missed its deadline")
        yield s, n, release, due, slot


def schedule(spark: SparkSession, weights: list[int], slots: int, lap: int | None = None) -> DataFrame:
    """sid, block, release, deadline, slot of at least the first ``slots``
    slots; sources are numbered as in ``weights``."""
    size = lap or min(MAX_LAP, max(LAP_SLOTS, 16 * len(weights)))
    size = min(size, max(1, slots))
    laps = -(-slots // size)

    def ends(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = [0] * len(weights)
        for k in range(laps):
            after = lap_end(weights, before, k * size, (k + 1) * size)
            yield pd.DataFrame({"lap": [k], "n0": [before], "n1": [after]})
            before = after

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, n0, n1 in zip(batch["lap"], batch["n0"], batch["n1"]):
                rows = lap_slots(weights, [int(n) for n in n0], [int(n) for n in n1], int(k) * size, (int(k) + 1) * size)
                yield pd.DataFrame(rows, columns=["sid", "block", "release", "deadline", "slot"])

    one = spark.range(1, numPartitions=1).mapInPandas(ends, "lap long, n0 array<long>, n1 array<long>")
    return one.repartition(min(laps, MAX_TASKS), "lap").mapInPandas(fill, "sid long, block long, release long, deadline long, slot long")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
        block_docs: int = BLOCK_DOCS, temperature: float = TEMPERATURE, lap: int | None = None) -> DataFrame:
    """Every row of ``docs`` (as struct ``row``) with its place in the mix:
    doc_id, source, block, release, deadline, slot, place (in the block),
    target (the source's weight as a share), selected.

    Target weights are given by source, or are the sources' shares of the
    documents to the power ``temperature``.  Sources without a weight (or with
    weight 0) are not selected and have no slot; weights of sources without
    documents are left out; more than ``MAX_SOURCES`` sources with a weight are
    an error.  A null source is a source of its own.  Every other row has a
    slot, and the mix is the rows by slot and place.

    ``selected`` holds up to the slot in which the first source has no block
    left: up to there each slot has one block, within its window, and at every
    slot before each source is less than one block from its target.  Later
    blocks come by deadline, so the remaining sources go on in the ratio of
    their weights; their slots are unique and rising but have gaps, and their
    windows say when they would have run.  Documents of a source come in an
    order that depends only on their ids (ties, by their content), so repeated
    rows are separate places.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.xxhash64(F.to_json(F.struct("*"))).alias("tie"))
    # ranges of the hash: a source of any size is numbered by many tasks, in the same order whatever their number
    bits = min(RANGE_BITS, max(1, (docs.count() // RANGE_DOCS).bit_length()))
    rows = rows.withColumn("rng", F.shiftright("h", 64 - bits))
    totals = {r[0]: r[1] for r in rows.groupBy("source").count().limit(MAX_SOURCES + 1).collect()}     # a number for each source
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:
        weights = {s: n ** temperature for s, n in totals.items()}
    names = sorted(totals, key=lambda s: (not weights.get(s, 0) > 0, s is not None, s or ""))      # those with a weight first
    whole = integer_weights([weights[s] for s in names if weights.get(s, 0) > 0])
    total = sum(whole)
    need = [-(-totals[s] // block_docs) for s in names]
    of_source = F.broadcast(spark.createDataFrame(
        [(i, s, whole[i] / total if i < len(whole) else None, need[i]) for i, s in enumerate(names)],
        "sid long, source string, target double, need long"))
    plan_type = "sid long, block long, release long, deadline long, slot long"
    plan, stop = spark.createDataFrame([], plan_type), 0
    if whole:
        # some source has run out by then
        slots = min(-(-(n + 1) * total // w) for n, w in zip(need, whole))
        plan = written(schedule(spark, whole, slots, lap), "mixing-slots")
        stop = plan.join(of_source, "sid").where("block >= need").agg(F.min("slot")).first()[0]
        plan = plan.where(F.col("slot") < stop)

    rows = rows.join(of_source, rows["source"].eqNullSafe(of_source["source"])).drop(of_source["source"])
    earlier = Window.partitionBy("sid").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("sid", "rng").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))) \
        .withColumn("first", F.expr(f"before div {block_docs}"))
    # the slots of a range's blocks, as one array: the documents are not shuffled for them
    blocks = starts.select("sid", "rng", F.explode(F.sequence("first", F.expr(f"(before + n - 1) div {block_docs}"))).alias("block"))
    of_range = blocks.join(plan, ["sid", "block"]).groupBy("sid", "rng").agg(
        F.sort_array(F.collect_list(F.struct("block", "release", "deadline", "slot"))).alias("plan"))
    starts = starts.join(of_range, ["sid", "rng"], "left").select("sid", "rng", "before", "first", "plan")

    place = F.row_number().over(Window.partitionBy("sid", "rng").orderBy("h", "doc_id", "tie")) - 1
    numbered = rows.withColumn("i", place.cast("long")).join(starts, ["sid", "rng"]).withColumn("i", F.col("i") + F.col("before"))
    numbered = numbered.withColumn("block", F.expr(f"i div {block_docs}")) \
        .withColumn("at", F.get("plan", (F.col("block") - F.col("first")).cast("int")))
    out = numbered.select(
        "row", "doc_id", "source", "block", F.col("at"), (F.col("i") % block_docs).cast("int").alias("place"), "target", "sid",
        F.floor(F.col("block") / F.col("target")).alias("release"),
        F.greatest(F.ceil((F.col("block") + 1) / F.col("target")), F.lit(stop)).alias("deadline"))
    late = F.lit(stop) + (F.col("deadline") - F.lit(stop)) * F.lit(len(names)) + F.col("sid")
    return out.select(
        "row", "doc_id", "source", "block", F.coalesce("at.release", "release").alias("release"),
        F.when(F.col("target").isNotNull(), F.coalesce("at.deadline", "deadline")).alias("deadline"),
        F.when(F.col("target").isNotNull(), F.coalesce("at.slot", late)).alias("slot"),
        "place", "target", F.col("at").isNotNull().alias("selected"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, with the columns of
    ``docs``: all rows of sources that have a weight."""
    return mix(docs, **options).where(F.col("slot").isNotNull()).orderBy("slot", "place").select("row.*")
