"""Nearest station of each row, exact, without a cross join.

A row's place on the space-filling curve is one number.  The cells of the
catalogue's grid (see ``stations``) are ranges of such numbers that cover the
globe, so a binary search in their sorted starts names the row's cell; one
equi-join brings that cell's few candidates, and an array minimum picks the
nearest.  Rows are read once and never multiplied.  Ties (equal distance to
the millimetre) go to the station that comes first in the catalogue (``ord``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEGREE, deg2rad, km_from_cosine, valid_coordinate
from .sphere import box_min_dot, box_ub, point_box_lb
from .stations import StationGrid, cell_i, cell_j, key_of, station_cells, station_lookup_grid

MAX_BROADCAST_BYTES = 64 << 20      # of a grid's rows; a larger grid is joined by a shuffle


def start_of(starts: Column, key: Column, n: int) -> Column:
    """Place (from 0) of the last of ``n`` sorted starts that is not above the
    key (never null): a binary search by steps of powers of two."""
    steps = F.array(*[F.lit(1 << t) for t in reversed(range(max(1, n.bit_length())))])
    at = F.aggregate(steps, F.lit(-1), lambda at, step: F.when(
        F.coalesce(F.get(starts, at + step) <= key, F.lit(False)), at + step).otherwise(at))
    return F.coalesce(at, F.lit(-1))


def fits_broadcast(grid: StationGrid) -> bool:
    return grid.facts["bytes"] <= MAX_BROADCAST_BYTES


def nearest_from_grid(
    df: DataFrame,
    grid: StationGrid,
    lat_col: str = "eventGeo_lat",
    lon_col: str = "eventGeo_long",
    broadcast: bool | None = None,
    salt: int = 1,
) -> DataFrame:
    """Stateless per-row lookup (works on streams): adds ``station_id`` and
    ``station_km``; rows without usable coordinates are dropped.

    The directory of starts is bounded (``DIRECTORY``); in a larger grid a
    start stands for several cells in a row, and the join also compares the
    range.  The grid is broadcast if its bytes allow.  Else the join is
    shuffled by the start; in batches adaptive execution splits hot ones, and
    with ``salt > 1`` (for streams) every cell is replicated ``salt`` times and
    each row picks one replica by a hash of its id (of its coordinates and
    day, where it has none), so a cell holding a third of all rows is spread
    over ``salt`` tasks; any replica gives the same answer.
    """
    n = grid.facts["starts"]
    lat, lon = F.col(lat_col), F.col(lon_col)
    if not n:
        none = F.lit(None)
        return df.withColumns({"station_id": none.cast("string"), "station_km": none.cast("double")}).where(F.lit(False))
    starts = grid.starts()
    rows = df.where(valid_coordinate(lat_col, lon_col)).withColumn("key__", key_of(cell_i(lat), cell_j(lon)))
    keyed = rows.withColumn("start__", start_of(starts, F.col("key__"), n))
    cells = grid.cells.select(start_of(starts, F.col("lo"), n).alias("cell__"), "lo", "hi", "cands")
    on = (F.col("start__") == F.col("cell__")) & (F.col("key__") >= F.col("lo")) & (F.col("key__") < F.col("hi"))
    if broadcast if broadcast is not None else fits_broadcast(grid):
        cells = F.broadcast(cells)
    elif salt > 1:
        spread = [c for c in ("globalEventID", "day", lat_col, lon_col) if c in df.columns]
        keyed = keyed.withColumn("salt__", F.pmod(F.xxhash64(*spread), F.lit(salt)).cast("int"))
        cells = cells.withColumn("copy__", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on = on & (F.col("salt__") == F.col("copy__"))
    found = keyed.join(cells, on).withColumns({"sin__": F.sin(deg2rad(lat)), "cos__": F.cos(deg2rad(lat))})
    far = F.transform("cands", lambda s: F.struct(
        km_from_cosine(F.col("sin__") * s["sin_lat"] + F.col("cos__") * s["cos_lat"] * F.cos(deg2rad(lon - s["lon"]))).alias("km"),
        s["ord"].alias("ord"), s["id"].alias("id")))
    best = F.array_min(F.transform(far, lambda s: F.struct(F.round(s["km"], 6).alias("k6"), s["ord"].alias("ord"), s["id"].alias("id"), s["km"].alias("km"))))
    return (
        found.withColumn("best__", best)
        .withColumns({"station_id": F.col("best__.id"), "station_km": F.col("best__.km")})
        .select(*df.columns, "station_id", "station_km")
    )


def nearest_station(
    df: DataFrame,
    stations: DataFrame,
    lat_col: str = "eventGeo_lat",
    lon_col: str = "eventGeo_long",
    max_km: float | None = None,
    broadcast_grid: bool | None = None,
) -> DataFrame:
    """Attach ``station_id`` and ``station_km`` to every row with coordinates.

    Rows look their cell up in the catalogue's persisted grid, so ``df`` is
    read once and, with the grid broadcast (after a check of its bytes),
    nothing is shuffled.  Rows without usable coordinates (null or NaN) are
    dropped, as are rows farther than ``max_km`` when given.
    """
    out = nearest_from_grid(df, station_lookup_grid(df.sparkSession, stations), lat_col, lon_col, broadcast_grid)
    if max_km is not None:
        out = out.where(F.col("station_km") <= F.lit(float(max_km)))
    return out


__all__ = [
    "KM_PER_DEGREE", "StationGrid", "box_min_dot", "box_ub", "fits_broadcast", "nearest_from_grid", "nearest_station",
    "point_box_lb", "start_of", "station_cells", "station_lookup_grid",
]
