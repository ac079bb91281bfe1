"""The geometric bounds behind the exact search, against dense sampling.

Safety: a lower bound (or a minimum) must never exceed the distance (or the
value) at any point of the box; an upper bound must never be below it.
"""

import numpy as np
from pyspark.sql import functions as F

from eventclime.operators.sphere import box_min_dot, box_ub, point_box_lb


def _boxes(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.uniform(-90, 85, n)
    h = rng.choice([0.2, 1.0, 5.6, 22.5], n)
    b = np.minimum(a + h, 90.0)
    l1 = rng.uniform(-180, 180 - 22.5, n)
    l2 = l1 + h
    return a, b, l1, l2, rng


def _arc(lat1, lon1, lat2, lon2):
    p1, p2, dl = np.radians(lat1), np.radians(lat2), np.radians(lon1 - lon2)
    c = np.sin(p1) * np.sin(p2) + np.cos(p1) * np.cos(p2) * np.cos(dl)
    return np.degrees(np.arccos(np.clip(c, -1, 1)))


def _sample(a, b, l1, l2, k=41):
    lat = np.linspace(a, b, k)
    lon = np.linspace(l1, l2, k)
    return np.meshgrid(lat, lon)


def test_distance_bounds_hold_over_the_box(spark):
    a, b, l1, l2, rng = _boxes(300, 1)
    s_lat, s_lon = rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300)
    rows = [tuple(map(float, r)) for r in zip(a, b, l1, l2, s_lat, s_lon)]
    df = spark.createDataFrame(rows, "a double, b double, l1 double, l2 double, s_lat double, s_lon double")
    c = {n: F.col(n) for n in df.columns}
    clat, clon = (c["a"] + c["b"]) / 2, (c["l1"] + c["l2"]) / 2
    r = F.lit(30.0)   # generous radius for the fallback
    got = df.select(
        point_box_lb(c["s_lat"], c["s_lon"], c["a"], c["b"], c["l1"], c["l2"]).alias("lb"),
        box_ub(c["a"], c["b"], c["l1"], c["l2"], clat, clon, r, c["s_lat"], c["s_lon"]).alias("ub"),
    ).collect()
    for (ai, bi, l1i, l2i, sl, so), g in zip(rows, got):
        la, lo = _sample(ai, bi, l1i, l2i)
        d = _arc(la, lo, sl, so)
        assert g.lb <= d.min() + 1e-7
        assert g.ub >= d.max() - 1e-7


def test_box_minimum_of_a_linear_function(spark):
    a, b, l1, l2, rng = _boxes(300, 2)
    n = rng.normal(size=(300, 3)) * rng.choice([1e-3, 1.0], size=(300, 1))
    rows = [tuple(map(float, r)) for r in zip(a, b, l1, l2, n[:, 0], n[:, 1], n[:, 2])]
    df = spark.createDataFrame(rows, "a double, b double, l1 double, l2 double, nx double, ny double, nz double")
    c = {k: F.col(k) for k in df.columns}
    got = df.select(box_min_dot(c["a"], c["b"], c["l1"], c["l2"], c["nx"], c["ny"], c["nz"]).alias("m")).collect()
    for (ai, bi, l1i, l2i, nx, ny, nz), g in zip(rows, got):
        la, lo = np.radians(_sample(ai, bi, l1i, l2i, 61))
        v = np.cos(la) * np.cos(lo) * nx + np.cos(la) * np.sin(lo) * ny + np.sin(la) * nz
        assert g.m <= v.min() + 1e-12          # never above the true minimum
        assert g.m >= v.min() - 1e-3 * np.linalg.norm([nx, ny, nz]) - 1e-12   # and close to it
