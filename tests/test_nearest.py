"""Nearest-station search against brute force on world-wide random points."""

import pytest
from pyspark.sql import functions as F

from eventclime.functions.geo import distance_km
from eventclime.operators import stations
from eventclime.operators.nearest import nearest_from_grid, nearest_station, start_of
from eventclime.operators.stations import station_lookup_grid


def _brute(pts, st):
    c = pts.distinct().crossJoin(st).withColumn("km", distance_km("lat", "lon", "latitude", "longitude"))
    return c.groupBy("lat", "lon").agg(
        F.min(F.struct(F.round("km", 6).alias("k6"), "ord", "id")).alias("b")
    ).select("lat", "lon", F.col("b.id").alias("bid"))


def _data(spark):
    st = spark.range(0, 200).select(
        F.concat(F.lit("S"), F.col("id").cast("string")).alias("id"),
        F.when(F.col("id") < 150, F.rand(1) * 20 + 25).otherwise(F.rand(2) * 180 - 90).alias("latitude"),
        F.when(F.col("id") < 150, F.rand(3) * 50 - 125).otherwise(F.rand(4) * 360 - 180).alias("longitude"),
        F.col("id").alias("ord"),
    )
    # duplicates of two stations with a later catalogue position: ties
    st = st.unionByName(st.where("id in ('S1', 'S5')").withColumn("ord", F.col("ord") + 1000)).cache()
    pts = spark.range(0, 600).select((F.rand(7) * 180 - 90).alias("lat"), (F.rand(8) * 360 - 180).alias("lon"))
    pts = pts.unionByName(spark.createDataFrame(
        [(90.0, 0.0), (-90.0, 10.0), (0.0, 179.999), (0.0, -180.0), (45.0, 180.0)], "lat double, lon double"))
    pts = pts.unionByName(st.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")))
    return st, pts


def _check(got, pts, st):
    """Every row once, with the station that brute force finds."""
    assert got.count() == pts.count()
    j = got.select("lat", "lon", "station_id").distinct().join(_brute(pts, st), ["lat", "lon"], "full")
    assert j.where(~F.col("station_id").eqNullSafe(F.col("bid"))).count() == 0


def test_grid_is_exact(spark):
    st, pts = _data(spark)
    _check(nearest_station(pts, st, "lat", "lon"), pts, st)


@pytest.mark.parametrize("directory", [5, 32_768])
def test_grid_of_many_small_cells_is_exact(spark, monkeypatch, directory):
    """Small limits force several levels of both trees; a short directory
    leaves several cells to a start."""
    monkeypatch.setattr(stations, "DIRECTORY", directory)
    st, pts = _data(spark)
    grid = station_lookup_grid(spark, st.where(F.lit(True)), base_level=3, leaf=2, nodes=16, candidates=4 if directory == 5 else 3)
    assert grid.facts["starts"] <= max(directory, 5) * 2 and grid.facts["cells"] > 100
    assert grid.cells.agg(F.max("gl")).first()[0] > 6
    _check(nearest_from_grid(pts, grid, "lat", "lon"), pts, st)
    _check(nearest_from_grid(pts, grid, "lat", "lon", broadcast=False), pts, st)


def test_cells_cover_all_keys_once(spark):
    st, _ = _data(spark)
    grid = station_lookup_grid(spark, st)
    rows = grid.cells.select("lo", "hi").orderBy("lo").collect()
    assert rows[0].lo == 0 and rows[-1].hi == 1 << (2 * stations.KEY_LEVEL + 1)
    assert all(a.hi == b.lo for a, b in zip(rows, rows[1:]))
    assert grid.directory.first().starts == [r.lo for r in rows]


def test_start_of_is_the_last_start_not_above(spark):
    for starts in ([0], [0, 5], [0, 5, 9, 10, 11, 30, 31]):
        df = spark.createDataFrame([(k, starts) for k in range(40)], "key long, starts array<long>")
        got = {r.key: r.at for r in df.select("key", start_of(F.col("starts"), F.col("key"), len(starts)).alias("at")).collect()}
        assert got == {k: max(i for i, x in enumerate(starts) if x <= k) for k in range(40)}


def test_plan_reads_rows_once_and_does_not_multiply_them(spark):
    st, pts = _data(spark)
    plan = nearest_station(pts, st, "lat", "lon")._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Generate", "Exchange hashpartitioning"):
        assert node not in plan, node


def test_dense_clusters_are_split_by_count(spark, tmp_path):
    """20,000 stations within 0.18 degrees, and some far away."""
    dense = spark.range(20_000).select(
        F.concat(F.lit("D"), F.col("id").cast("string")).alias("id"), (F.rand(11) * 0.17 + 38.0).alias("latitude"),
        (F.rand(12) * 0.17 - 100.0).alias("longitude"), F.col("id").alias("ord"))
    st = dense.unionByName(dense.where("id in ('D3', 'D7')").withColumn("ord", F.col("ord") + 100_000)).unionByName(
        _data(spark)[0].select("id", "latitude", "longitude", (F.col("ord") + 1_000_000).alias("ord")))
    st.write.parquet(str(tmp_path / "st"))
    st = spark.read.parquet(str(tmp_path / "st"))
    near = spark.range(150).select((F.rand(13) * 0.3 + 37.9).alias("lat"), (F.rand(14) * 0.3 - 100.1).alias("lon"))
    far = spark.range(50).select((F.rand(15) * 180 - 90).alias("lat"), (F.rand(16) * 360 - 180).alias("lon"))
    at = st.where("ord % 100 = 7").select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    pts = near.unionByName(far).unionByName(at)
    grid = station_lookup_grid(spark, st)
    assert grid.facts["largest_group"] <= 20_000 / 5, grid.facts
    assert grid.cells.agg(F.max(F.size("cands"))).first()[0] <= stations.CANDIDATES
    _check(nearest_from_grid(pts, grid, "lat", "lon"), pts, st)


def test_salted_grid_join_matches_broadcast(spark):
    """The shuffled (salted) grid join gives the same stations."""
    from eventclime.streaming.pipeline import located_event_stream, station_lookup_grid
    from eventclime.plans.batch_queries import _fx
    from eventclime.operators import filters
    from conftest import SF_SMALL

    fx = _fx(spark, SF_SMALL)
    grid = station_lookup_grid(spark, fx["stations"].where(filters.station_prefix()))
    a = located_event_stream(fx["events"], grid, broadcast_grid=True).select("globalEventID", "station_id")
    b = located_event_stream(fx["events"], grid, broadcast_grid=False).select("globalEventID", "station_id")
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_rows_are_read_once_and_shuffled_lookup_agrees(spark):
    st, pts = _data(spark)
    rows = pts.unionByName(spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "lat double, lon double"))
    a = nearest_station(rows, st, "lat", "lon", broadcast_grid=True)
    b = nearest_station(rows, st, "lat", "lon", broadcast_grid=False)
    assert "Exchange hashpartitioning" not in a._jdf.queryExecution().executedPlan().toString()
    want = pts.join(_brute(pts, st), ["lat", "lon"]).select("lat", "lon", "bid")
    for got in (a, b):
        got = got.select("lat", "lon", "station_id")
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert nearest_station(rows, st.limit(0), "lat", "lon").count() == 0


def test_copies_of_stations_change_neither_cells_nor_winners(spark):
    st, pts = _data(spark)
    copies = st.select("id", "latitude", "longitude", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"), "ord").select(
        F.concat("id", F.lit("-"), "k").alias("id"), "latitude", "longitude", (F.col("ord") + F.col("k") * 10000).alias("ord"))
    one, many = station_lookup_grid(spark, st), station_lookup_grid(spark, copies)
    assert all(one.facts[c] == many.facts[c] for c in ("cells", "entries", "starts", "largest_group")), (one.facts, many.facts)
    a, b = (nearest_from_grid(pts.distinct(), g, "lat", "lon") for g in (one, many))
    assert a.join(b, ["lat", "lon"]).where(F.concat(a["station_id"], F.lit("-0")) == b["station_id"]).count() == a.count()


def test_three_stations_need_no_splits(spark):
    st, _ = _data(spark)
    grid = station_lookup_grid(spark, st.where("id in ('S2', 'S3', 'S4')"))
    assert grid.cells.agg(F.min("gl"), F.max("gl")).first() == (5, 5)


def test_half_written_tables_are_not_read(spark):
    from eventclime.operators.stations import catalogue_fingerprint, clean_stations, persisted
    from eventclime.session import shared_dir

    st, _ = _data(spark)
    st = st.where("ord < 7")

    def build(folder):
        clean_stations(st).write.parquet(f"{folder}/places")
        return {"n": 7}

    path = f"{shared_dir(spark)}/eventclime-index/t-half-{catalogue_fingerprint(st)}"
    clean_stations(st).limit(2).write.mode("overwrite").parquet(f"{path}/tables-lost/places")
    for _ in range(2):
        folder, facts = persisted(st, "t-half", build)
        assert spark.read.parquet(f"{folder}/places").count() == clean_stations(st).count() == facts["n"]


@pytest.mark.parametrize("where, most", [("parallel", 10), ("meridian", 16)])
def test_stations_on_a_circle_do_not_split_its_centre_without_end(spark, monkeypatch, where, most):
    """48 stations are equally near to both poles, or to two points of the
    equator; and to the stations of a parallel every cell at a pole is the same."""
    at = F.lit(24.0) + F.col("id") * 0.5
    fixed = F.lit(48.375 if where == "parallel" else -124.0)
    st = spark.range(48).select(
        F.concat(F.lit("C"), F.col("id").cast("string")).alias("id"), (fixed if where == "parallel" else at).alias("latitude"),
        (at - 120.0 if where == "parallel" else fixed).alias("longitude"), (F.lit(100) - F.col("id")).alias("ord"))
    rounds, split = [], stations._split

    def counted(cells):
        rounds.append(1)
        assert len(rounds) <= most, "cells are split without end"
        return split(cells)

    monkeypatch.setattr(stations, "_split", counted)
    grid = station_lookup_grid(spark, st)
    assert grid.cells.agg(F.max("gl")).first()[0] <= stations.BASE_LEVEL + most
    pts = [(float(lat), float(lon)) for lat in (90, 89.9999999, 88, 84.5, -84.5, -89.99, -90) for lon in (-180, -124, -100.3, 0, 57.1, 146)]
    pts += [(lat, lon) for lat in (0.0, 1e-7, -0.003, 0.02) for lon in (-34.0, 146.0, 146.0000001, 145.99)]
    pts = spark.createDataFrame(pts, "lat double, lon double")
    _check(nearest_from_grid(pts, grid, "lat", "lon"), pts, st)
