"""Bounds of great-circle distances between points and latitude/longitude
boxes, as column expressions (``tests/test_bounds.py`` checks them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geo import arc_degrees


def point_box_lb(plat: Column, plon: Column, a: Column, b: Column, l1: Column, l2: Column) -> Column:
    """Exact great-circle distance (degrees) from a point to a lat/lon box.

    Inside the box's longitude range the nearest point lies on the point's
    meridian.  Outside it, distance at a fixed latitude grows with the
    longitude gap, so the nearest point lies on the nearer edge meridian:
    either the foot of the perpendicular (gap below 90 degrees and the foot
    within the edge) or one of the edge's two corners.
    """
    e1 = F.pmod(l1 - plon, F.lit(360.0))
    e2 = F.pmod(plon - l2, F.lit(360.0))
    inside = F.pmod(plon - l1, F.lit(360.0)) <= (l2 - l1)
    dlam = F.least(e1, e2)
    edge = F.when(e1 <= e2, l1).otherwise(l2)
    d_lat = F.greatest(F.lit(0.0), a - plat, plat - b)
    foot = F.degrees(F.atan(F.tan(F.radians(plat)) / F.cos(F.radians(dlam))))
    cross = F.degrees(F.asin(F.least(F.lit(1.0), F.cos(F.radians(plat)) * F.sin(F.radians(dlam)))))
    corner = F.least(arc_degrees(plat, plon, a, edge), arc_degrees(plat, plon, b, edge))
    outside = F.when((dlam < F.lit(90.0)) & (foot >= a) & (foot <= b), cross).otherwise(corner)
    return F.when(inside, d_lat).otherwise(outside)


def box_ub(a: Column, b: Column, l1: Column, l2: Column, clat: Column, clon: Column, r: Column,
           s_lat: Column, s_lon: Column) -> Column:
    """Upper bound (degrees) of the distance from any point of a box to a
    station.

    When the whole box lies within 90 degrees of longitude of the station,
    distance along each edge has no interior maximum, so the farthest point is
    a corner.  Otherwise the centre's distance plus the box radius is used.
    """
    def gap(l):
        return F.abs(F.pmod(l - s_lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0))

    near_side = (gap(l1) <= F.lit(90.0)) & (gap(l2) <= F.lit(90.0))
    corners = F.greatest(
        arc_degrees(a, l1, s_lat, s_lon), arc_degrees(a, l2, s_lat, s_lon),
        arc_degrees(b, l1, s_lat, s_lon), arc_degrees(b, l2, s_lat, s_lon),
    )
    fallback = F.least(F.lit(180.0), arc_degrees(clat, clon, s_lat, s_lon) + r)
    return F.when(near_side, corners).otherwise(fallback)


def unit(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def box_min_dot(a: Column, b: Column, l1: Column, l2: Column, nx: Column, ny: Column, nz: Column) -> Column:
    """Exact minimum of ``p . n`` over the points ``p`` of a lat/lon box.

    A linear function on the sphere has its only interior minimum at
    ``-n/|n|``; on a meridian edge it is ``A cos(phi) + B sin(phi)`` and on
    a parallel edge ``cos(phi) R cos(lam - lam0) + nz sin(phi)``, each with
    one closed-form minimiser.  The minimum is the least of the corners,
    those minimisers that fall on their edge, and the interior point.
    """
    big = F.lit(10.0)   # above any dot product of unit-ish vectors

    def f(phi_deg, lam_deg):
        ux, uy, uz = unit(phi_deg, lam_deg)
        return ux * nx + uy * ny + uz * nz

    def in_lat(phi_deg):
        return (phi_deg >= a) & (phi_deg <= b)

    def in_lon(lam_deg):
        return F.pmod(lam_deg - l1, F.lit(360.0)) <= (l2 - l1)

    vals = [f(a, l1), f(a, l2), f(b, l1), f(b, l2)]
    for lam in (l1, l2):                       # meridian edges
        r = F.radians(lam)
        A = nx * F.cos(r) + ny * F.sin(r)
        phi_m = F.degrees(F.atan2(-nz, -A))
        vals.append(F.when(in_lat(phi_m), -F.sqrt(A * A + nz * nz)).otherwise(big))
    R = F.sqrt(nx * nx + ny * ny)
    lam_m = F.degrees(F.atan2(ny, nx)) + F.lit(180.0)
    for phi in (a, b):                         # parallel edges
        vals.append(F.when(in_lon(lam_m), -F.cos(F.radians(phi)) * R + nz * F.sin(F.radians(phi))).otherwise(big))
    norm = F.sqrt(nx * nx + ny * ny + nz * nz)
    safe = F.when(norm > 0, norm).otherwise(F.lit(1.0))   # n = 0: c is s itself
    lat_i = F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -nz / safe))))
    lon_i = F.degrees(F.atan2(-ny, -nx))
    vals.append(F.when((norm > 0) & in_lat(lat_i) & in_lon(lon_i), -norm).otherwise(big))
    return F.least(*vals)
