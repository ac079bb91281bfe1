"""Station index: which stations can be the nearest to a point.

The globe is cut into cells that halve in latitude and longitude, numbered
along a space-filling (Z-order) curve, so a cell is a range of keys and a point
has one key.  Two trees meet:

* the station tree groups a catalogue by key; a node with more than ``LEAF``
  stations is split, however close they are, and has a tight box and one
  representative station;
* the grid's cells start at 5.6 degrees; each holds the nodes that can contain
  a nearest station of some point in it.  A node stays while its lower bound
  (distance of the cell to the node's box) is not above the least upper bound
  (distance from the cell's farthest point to a representative).

Round by round, a cell with more than ``NODES`` of its nodes near it is split
in four, any other gets its nodes' children, and a cell of stations only is
final with at most ``CANDIDATES`` of them (else it is split).  A row of a cell
also goes if a station beats all of its stations at every point of the cell,
so a far cell holds only the side of a cluster that faces it.  Thus neither a
dense cluster nor a large catalogue gathers in one group; only stations within
a last cell (0.3 m) are not told apart, and stations on a circle around a point
far from all of them: no cell that holds the point, however small, tells them
apart, and a pole lies in 2^(k+1) cells of level k.  So a cell of stations only
is also final, with any number of them, if the nearest is more than ``FAR`` of
its heights away (``POLAR_FAR`` at a pole).  The cells cover the globe, and
depend on the catalogue alone: they are written once per catalogue, in key
order, with the facts a lookup needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import arc_degrees, deg2rad, valid_coordinate
from .sphere import box_min_dot, box_ub, point_box_lb, unit

KEY_LEVEL = 26          # last level: cells of 180 / 2^26 degrees
TOP_LEVEL = 2           # the station tree's first: 4 x 8 cells of 45 degrees
STEP = 2                # levels from a node to its children
BASE_LEVEL = 5          # the grid's first cells: 5.6 degrees
LEAF = 16               # stations of a tree node that is not split
NODES = 64              # nodes of a cell that is not split
CANDIDATES = 32         # stations of a final cell
DIRECTORY = 32_768      # cell starts that a row searches at most: 256 KB
SLACK_DEG = 1e-5        # about 1 m: absorbs rounding of the cosine formula
FAR = 8192              # heights of a cell beyond which its nearest station counts as far
POLAR_FAR = 8           # the same for a cell at a pole
FORMAT = 6              # bump when the tables change, so that stale ones are not reused


# ------------------------------------------------------------------- keys --

def cell_i(lat: Column, k: int = KEY_LEVEL) -> Column:
    h = 180.0 / (2 ** k)
    return F.least(F.greatest(F.floor((lat + F.lit(90.0)) / F.lit(h)), F.lit(0)), F.lit(2 ** k - 1)).cast("long")


def cell_j(lon: Column, k: int = KEY_LEVEL) -> Column:
    h = 180.0 / (2 ** k)
    return F.pmod(F.floor((lon + F.lit(180.0)) / F.lit(h)), F.lit(2 ** (k + 1))).cast("long")


# (shift, mask) that put a zero between the bits of a number of up to 32 bits
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def key_of(i: Column, j: Column) -> Column:
    """Z-order key of cell (i, j): the bits of i and j in turn.  It is never
    null, so that no filter is inferred from a join on it."""
    steps = F.array(*[F.struct(F.lit(shift).alias("shift"), F.lit(mask).alias("mask")) for shift, mask in _SPREAD])

    def spread(x: Column) -> Column:
        return F.aggregate(steps, x, lambda a, s: F.call_function("shiftleft", a, s["shift"]).bitwiseOR(a).bitwiseAND(s["mask"]))

    return F.coalesce(F.shiftleft(spread(i), 1).bitwiseOR(spread(j)), F.lit(0).cast("long"))


# ----------------------------------------------------------------- tables --

def catalogue_fingerprint(stations: DataFrame) -> str:
    """Content hash of a station catalogue (order-insensitive; one small
    aggregate job)."""
    h = F.xxhash64("id", "latitude", "longitude", F.col("ord").cast("string"))
    r = stations.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{int(r['s'] or 0):x}"


def persisted(stations: DataFrame, name: str, build: Callable[[str], dict]) -> tuple[str, dict]:
    """(folder, facts) of tables that derive from the catalogue only, built
    once per catalogue (told by its content hash) under the shared folder.

    ``build`` writes them into a folder of their own and returns facts about
    them; a one-row table with both is written last, so tables that are only
    half there are never read.
    """
    from ..session import shared_dir

    spark = stations.sparkSession
    path = f"{shared_dir(spark)}/eventclime-index/{name}-{catalogue_fingerprint(stations)}"

    def published():
        try:
            return spark.read.schema("path string, facts string").parquet(f"{path}/published").orderBy("path").first()
        except AnalysisException:
            return None

    if published() is None:
        folder = f"{path}/tables-{uuid.uuid4().hex}"
        facts = build(folder)
        spark.range(1).select(F.lit(folder).alias("path"), F.lit(json.dumps(facts)).alias("facts")).write.mode("append").parquet(f"{path}/published")
    row = published()
    return row["path"], json.loads(row["facts"])


def clean_stations(stations: DataFrame) -> DataFrame:
    """Stations with usable coordinates, in the index's column names.

    Of stations at the same place only the first in catalogue order can be
    the nearest, so one row per coordinate is kept.
    """
    return (
        stations.where(valid_coordinate("latitude", "longitude"))
        .groupBy((F.col("latitude") + F.lit(0.0)).alias("s_lat"), (F.col("longitude") + F.lit(0.0)).alias("s_lon"))
        .agg(F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord"))
        .select("id", "s_lat", "s_lon", "ord")
    )


# ------------------------------------------------------------------- tree --

_NODE = ["ck", "cp", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "rep", "station"]


def station_tree(stations: DataFrame, folder: str, leaf: int = LEAF) -> DataFrame:
    """Children of every node (k, p): key, box, representative, and whether
    the child is a station.  Written into ``folder``; one row a node and one a
    station, and none groups more than ``leaf`` stations or 16 nodes (stations
    within one cell of the last level excepted)."""
    spark = stations.sparkSession
    clean_stations(stations).withColumn("z", key_of(cell_i(F.col("s_lat")), cell_j(F.col("s_lon")))).write.parquet(f"{folder}/places")
    places = spark.read.parquet(f"{folder}/places")
    levels = F.explode(F.array(*[F.lit(k) for k in range(TOP_LEVEL, KEY_LEVEL + 1, STEP)])).alias("ck")
    rep = F.struct("id", "s_lat", "s_lon", "ord")
    prefix = F.expr(f"shiftright(z, 2 * ({KEY_LEVEL} - ck))")
    keyed = places.select("*", levels).withColumn("cp", prefix)
    keyed.groupBy("ck", "cp").agg(
        F.min("s_lat").alias("lat_lo"), F.max("s_lat").alias("lat_hi"), F.min("s_lon").alias("lon_lo"), F.max("s_lon").alias("lon_hi"),
        F.min_by(rep, "ord").alias("rep"), F.count(F.lit(1)).alias("n"),
    ).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    parents = nodes.where(F.col("n") > leaf).select((F.col("ck") + STEP).alias("ck"), F.col("cp").alias("pp"))
    # a node is in the tree if its parent was split
    split = nodes.withColumn("pp", F.shiftright("cp", 2 * STEP)).join(parents, ["ck", "pp"], "left_semi")
    top = nodes.where(F.col("ck") == TOP_LEVEL).withColumn("pp", F.lit(0).cast("long")).select(split.columns)
    inside = split.unionByName(top)
    leaves = inside.where((F.col("n") <= leaf) | (F.col("ck") == KEY_LEVEL)).select("ck", "cp")
    here = [F.col(c).alias(n) for c, n in (("s_lat", "lat_lo"), ("s_lat", "lat_hi"), ("s_lon", "lon_lo"), ("s_lon", "lon_hi"))]
    of_leaves = keyed.join(leaves, ["ck", "cp"]).select(
        F.col("ck").alias("k"), F.col("cp").alias("p"), F.lit(KEY_LEVEL + 1).alias("ck"), F.col("z").alias("cp"), *here, rep.alias("rep"), F.lit(True).alias("station"))
    of_nodes = inside.select((F.col("ck") - STEP).alias("k"), F.col("pp").alias("p"), "ck", "cp", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "rep",
                             F.lit(False).alias("station"))
    of_nodes.unionByName(of_leaves).write.parquet(f"{folder}/children")
    return spark.read.parquet(f"{folder}/children")


# ------------------------------------------------------------------- grid --

_CELL = ["gl", "gi", "gj"]


def _geometry() -> dict[str, Column]:
    """Box (qa..qb latitude, ql1..ql2 longitude), centre and radius of a cell."""
    h = F.lit(180.0) / F.pow(F.lit(2.0), F.col("gl").cast("double"))
    a, l1 = F.col("gi") * h - F.lit(90.0), F.col("gj") * h - F.lit(180.0)
    least = F.when((a <= 0) & (a + h >= 0), F.lit(0.0)).otherwise(F.least(F.abs(a), F.abs(a + h)))
    return {"qa": a, "qb": a + h, "ql1": l1, "ql2": l1 + h, "qlat": a + h / 2, "qlon": l1 + h / 2,
            "qr": h / 2 + h / 2 * F.cos(F.radians(least))}


_BOX = ["qa", "qb", "ql1", "ql2"]


def _pruner() -> Callable[[DataFrame], DataFrame]:
    """A function that drops the rows which cannot hold a nearest station of
    their cell; its expressions are made once for all rounds.  It adds ``n``
    and ``n_inner`` (the cell's rows, and those that are not stations),
    ``n_near`` (rows within two heights of the cell) and ``far`` (whether its
    nearest station is far: see ``FAR``).

    First by distance: a row stays if the lower bound of its distance to the
    cell is not above the least upper bound to a representative.  Then by
    dominance: a row goes if one representative is closer than all its
    stations at every point of the cell.  Competitors are the five nearest to
    the corners and the centre (not all pairs), of all of the cell's rows and
    of those in the row's own region, which is as large as the cell.  With
    ``m`` and ``r`` the row's centre and radius, ``p . s`` is at most ``p . m +
    r min(1, t)`` for its stations ``s`` at an angle of at most ``t`` from
    ``p``; so they are beaten if ``p . (c - m) > r min(1, t)`` and a margin at
    every point ``p`` of the box.  The margin is worth more than the millimetre
    that distances are compared to: a difference of ``d`` in the dot product is
    one of ``d / min(1, t)`` in the angle at least.
    """
    w = Window.partitionBy(*_CELL)
    box, near = [F.col(c) for c in _BOX], F.col("rep")
    lat_lo, lat_hi, lon_lo, lon_hi = (F.col(c) for c in ("lat_lo", "lat_hi", "lon_lo", "lon_hi"))
    lower = F.when(F.col("station"), point_box_lb(near["s_lat"], near["s_lon"], *box)).otherwise(
        point_box_lb(F.col("qlat"), F.col("qlon"), lat_lo, lat_hi, lon_lo, lon_hi) - F.col("qr"))
    upper = box_ub(*box, F.col("qlat"), F.col("qlon"), F.col("qr"), near["s_lat"], near["s_lon"])
    bounds, least_upper = {"lower": lower, "upper": upper}, F.min("upper").over(w)
    close, geometry = F.col("lower") <= F.col("least_upper") + F.lit(SLACK_DEG), _geometry()

    refs = [("qa", "ql1"), ("qa", "ql2"), ("qb", "ql1"), ("qb", "ql2"), ("qlat", "qlon")]
    nearest = [F.min_by(F.struct(near["s_lat"].alias("s_lat"), near["s_lon"].alias("s_lon")), arc_degrees(F.col(a), F.col(b), near["s_lat"], near["s_lon"]))
               for a, b in refs]
    level = F.least(F.col("ck"), F.lit(KEY_LEVEL))
    region = F.call_function("shiftright", F.col("cp"), F.greatest(F.lit(0), 2 * (level - F.col("gl"))))
    here = Window.partitionBy(*_CELL, "level", "region")
    rivals = {f"c{k}__": rival.over(part) for k, (rival, part) in enumerate([*[(r, w) for r in nearest], *[(r, here) for r in nearest]])}
    names = list(rivals)
    least = F.when((lat_lo <= 0) & (lat_hi >= 0), F.lit(0.0)).otherwise(F.least(F.abs(lat_lo), F.abs(lat_hi)))
    radius = F.radians((lat_hi - lat_lo) / 2 + (lon_hi - lon_lo) / 2 * F.cos(F.radians(least)))
    x, y, z = unit((lat_lo + lat_hi) / 2, (lon_lo + lon_hi) / 2)

    def difference(c: Column) -> Column:
        cx, cy, cz = unit(c["s_lat"], c["s_lon"])
        return F.struct((cx - x).alias("x"), (cy - y).alias("y"), (cz - z).alias("z"))

    # one bound over an array of competitors: five copies of it are too much code to compile
    normals = F.transform(F.array_distinct(F.array(*names)), difference)
    angle = F.least(F.lit(1.0), F.radians("upper") + 2 * F.col("radius"))
    beaten = F.exists(normals, lambda n: box_min_dot(*box, n["x"], n["y"], n["z"]) > angle * (F.col("radius") + F.lit(2e-10)) + F.lit(1e-14))
    own = {"level": F.least(level, F.col("gl")), "region": region, "radius": radius}
    height = F.col("qb") - F.col("qa")
    heights = F.when((F.col("qa") == -90.0) | (F.col("qb") == 90.0), F.lit(POLAR_FAR)).otherwise(F.lit(FAR))
    out = [*_CELL, *_NODE, F.count(F.lit(1)).over(w).alias("n"), F.count_if(~F.col("station")).over(w).alias("n_inner"),
           F.count_if(F.col("lower") <= 2 * height).over(w).alias("n_near"),
           (F.col("least_upper") > heights * height).alias("far")]

    def prune(frontier: DataFrame) -> DataFrame:
        kept = frontier.withColumns(geometry).withColumns(bounds).withColumn("least_upper", least_upper).where(close)
        return kept.withColumns(own).withColumns(rivals).where(~beaten).select(*out)

    return prune


def _split(cells: DataFrame) -> DataFrame:
    """Four children of each cell, with the cell's nodes."""
    kids = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("c")
    return cells.select(*_CELL, *_NODE, kids).select(
        (F.col("gl") + 1).alias("gl"), (F.col("gi") * 2 + F.col("c.a")).alias("gi"), (F.col("gj") * 2 + F.col("c.b")).alias("gj"), *_NODE)


def station_cells(stations: DataFrame, folder: str, base_level: int = BASE_LEVEL, leaf: int = LEAF, nodes: int = NODES,
                  candidates: int = CANDIDATES) -> dict:
    """Build the grid into ``folder``: ``cells`` (lo, hi, cands: id, lon,
    sin_lat, cos_lat, ord) in key order and ``directory`` (starts, sorted).
    Returns its facts: cells, entries, bytes, starts, and the largest group
    that a round met."""
    spark = stations.sparkSession
    children = station_tree(stations, folder, leaf)
    n_lon = 2 ** (base_level + 1)
    base = spark.range(0, (2 ** base_level) * n_lon).select(
        F.lit(base_level).alias("gl"), F.expr(f"id div {n_lon}").alias("gi"), F.expr(f"id % {n_lon}").alias("gj"))
    # every first cell meets the tree's first nodes: 2,048 cells, at most 32 nodes
    tops = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 ** (2 * TOP_LEVEL + 1) - 1).cast("long"))).alias("cp")
    frontier = base.select(*_CELL, tops).join(children.where(F.col("k") == TOP_LEVEL - STEP), "cp").select(*_CELL, *_NODE)
    final, largest, rounds, prune = [], 0, 0, _pruner()
    last, plain = F.col("gl") == KEY_LEVEL, F.col("n_inner") == 0
    done = plain & ((F.col("n") <= candidates) | last | F.col("far"))
    split = ~last & ~done & (plain | (F.col("n_near") > nodes))
    # the rows are few and small, but cost much each: with the number given, adaptive execution does not put them into one task
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        at = prune(frontier.repartition(parts, *_CELL)).checkpoint(eager=True)      # cuts the lineage between rounds
        met, n_done, n_split, n_grown = at.agg(F.max("n"), F.count_if(done), F.count_if(split), F.count_if(~done & ~split)).first()
        rounds, largest = rounds + 1, max(largest, met or 0)
        if n_done:
            final.append(at.where(done).select(*_CELL, "rep"))
        new = [_split(at.where(split))] if n_split else []
        if n_grown:
            grown = at.where(~done & ~split)
            born = grown.where(~F.col("station")).select(*_CELL, F.col("ck").alias("k"), F.col("cp").alias("p")).join(children, ["k", "p"])
            new += [grown.where("station").select(*_CELL, *_NODE), born.select(*_CELL, *_NODE)]
        if not new:
            break
        frontier = new[0]
        for df in new[1:]:
            frontier = frontier.unionByName(df)
    cells = final[0] if final else at.select(*_CELL, "rep")
    for df in final[1:]:
        cells = cells.unionByName(df)

    lat = deg2rad(F.col("rep.s_lat"))
    entry = F.struct(F.col("rep.id").alias("id"), F.col("rep.s_lon").alias("lon"), F.sin(lat).alias("sin_lat"), F.cos(lat).alias("cos_lat"),
                     F.col("rep.ord").alias("ord"))
    cells = cells.groupBy(*_CELL).agg(F.collect_list(entry).alias("cands")).withColumn("z", key_of(F.col("gi"), F.col("gj")))
    below = F.expr(f"2 * ({KEY_LEVEL} - gl)")
    shift = lambda c: F.call_function("shiftleft", c, below)
    cells.select(shift(F.col("z")).alias("lo"), shift(F.col("z") + 1).alias("hi"), "gl", "cands").orderBy("lo").write.parquet(f"{folder}/cells")
    cells = spark.read.parquet(f"{folder}/cells")
    size = F.size("cands") * 72 + F.aggregate("cands", F.lit(0), lambda a, c: a + F.octet_length(c["id"])) + 64
    n, entries, volume = cells.agg(F.count(F.lit(1)), F.sum(F.size("cands")), F.sum(size)).first()
    every = 1 if n <= DIRECTORY else -(-2 * n // DIRECTORY)      # about half a directory of a larger grid's starts, and the first
    some = F.when(F.pmod(F.xxhash64("lo"), F.lit(every)) == 0, F.col("lo"))
    cells.agg(F.array_sort(F.array_distinct(F.concat(F.collect_list(some), F.collect_set(F.when(F.col("lo") == 0, F.col("lo")))))).alias("starts")) \
        .write.parquet(f"{folder}/directory")
    n_starts = spark.read.parquet(f"{folder}/directory").agg(F.max(F.size("starts"))).first()[0]
    return {"cells": n, "entries": entries or 0, "bytes": volume or 0, "starts": n_starts or 0, "largest_group": largest, "rounds": rounds}


@dataclass
class StationGrid:
    """A catalogue's published grid."""

    cells: DataFrame
    directory: DataFrame
    facts: dict

    def starts(self) -> Column:
        """The directory as one constant (``DIRECTORY`` numbers at most)."""
        numbers = [x for r in self.directory.collect() for x in r.starts]
        return F.from_json(F.lit(json.dumps(numbers)), "array<bigint>")


def read_grid(spark: SparkSession, folder: str, facts: dict) -> StationGrid:
    return StationGrid(spark.read.parquet(f"{folder}/cells"), spark.read.parquet(f"{folder}/directory"), facts)


def station_lookup_grid(spark: SparkSession, stations: DataFrame, **limits) -> StationGrid:
    """Grid for row-level lookups, in batches and streams; written once per
    catalogue and reused by every job and restart."""
    how = {"base_level": BASE_LEVEL, "leaf": LEAF, "nodes": NODES, "candidates": CANDIDATES} | limits
    name = "-".join(["station-grid", f"v{FORMAT}", *[str(how[c]) for c in sorted(how)]])
    return read_grid(spark, *persisted(stations, name, lambda folder: station_cells(stations, folder, **how)))
