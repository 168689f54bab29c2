"""Geometry as column expressions: distances, boxes, rings as arrays of points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
#: Metres of one degree of latitude.
DEGREE_M = math.pi / 180 * EARTH_M


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere of EARTH_M; the root's argument is clamped to 1."""
    s1, s2 = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def project(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular metres about an origin."""
    return (lon - lon0) * F.lit(DEGREE_M) * F.cos(F.radians(lat0)), (lat - lat0) * F.lit(DEGREE_M)


def unproject(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Latitude and longitude of projected metres."""
    return lat0 + y / F.lit(DEGREE_M), lon0 + x / (F.lit(DEGREE_M) * F.cos(F.radians(lat0)))


def in_box(lat: Column, lon: Column, s: Column, w: Column, n: Column, e: Column) -> Column:
    return lat.between(s, n) & lon.between(w, e)


def expand_box(s: Column, w: Column, n: Column, e: Column, metres: Column) -> tuple[Column, Column, Column, Column]:
    """A box grown by ``metres`` on every side; longitude by the latitude that is furthest out."""
    up = metres / F.lit(DEGREE_M)
    wide = up / F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs(s), F.abs(n)))))
    return s - up, w - wide, n + up, e + wide


def box_area_m2(s: Column, w: Column, n: Column, e: Column) -> Column:
    return (n - s) * F.lit(DEGREE_M) * (e - w) * F.lit(DEGREE_M) * F.cos(F.radians((s + n) / 2))


def cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a, b, c."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment; a segment of one point is that point."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length2))).otherwise(F.lit(0.0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def edge_crossed(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether a ray to the right of a point crosses the edge; an odd count is inside."""
    return ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)


def ring_edges(ring: str) -> Column:
    """(x1, y1, x2, y2) of a closed ring given as an array of (x, y)."""
    n = F.size(ring)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.get(ring, i)["x"].alias("x1"), F.get(ring, i)["y"].alias("y1"), F.get(ring, (i + 1) % n)["x"].alias("x2"), F.get(ring, (i + 1) % n)["y"].alias("y2")),
    )


def ring_area(ring: str) -> Column:
    """Area of a simple ring, by the shoelace rule."""
    total = F.aggregate(ring_edges(ring), F.lit(0.0), lambda a, e: a + e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.abs(total) / 2


def in_ring(px: Column, py: Column, ring: str) -> Column:
    odd = F.aggregate(ring_edges(ring), F.lit(False), lambda a, e: a != edge_crossed(px, py, e["x1"], e["y1"], e["x2"], e["y2"]))
    return odd


def ring_distance(px: Column, py: Column, ring: str) -> Column:
    """From a point to the ring's nearest edge."""
    return F.array_min(F.transform(ring_edges(ring), lambda e: segment_distance(px, py, e["x1"], e["y1"], e["x2"], e["y2"])))
