"""Geodesy and plane geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Equatorial radius in km and flattening (WGS 84), mean radius in km.
EARTH_A_KM, EARTH_F = 6378.137, 1 / 298.257223563
EARTH_R_KM = 6371.0088


def geodetic_to_fixed(lat_deg: Column, lon_deg: Column, h_km: Column, a: float = EARTH_A_KM, f: float = EARTH_F) -> list[Column]:
    """Body-fixed x, y, z in km."""
    e2 = f * (2 - f)
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return [(n + h_km) * F.cos(lat) * F.cos(lon), (n + h_km) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + h_km) * F.sin(lat)]


def fixed_to_geodetic(x: Column, y: Column, z: Column, a: float = EARTH_A_KM, f: float = EARTH_F, steps: int = 6) -> list[Column]:
    """Latitude and longitude in degrees and height in km, by fixed-point iteration of the sine of the latitude."""
    e2 = f * (2 - f)
    p = F.sqrt(x * x + y * y)

    def step(lat: Column) -> Column:
        s = F.sin(lat)
        return F.atan2(z + e2 * a / F.sqrt(1 - e2 * s * s) * s, p)

    # an array of one holds each step's value, so that expressions don't grow with the steps
    lat = F.array(F.atan2(z, p * (1 - e2)))
    for _ in range(steps):
        lat = F.transform(lat, step)
    return [F.degrees(lat[0]), F.degrees(F.atan2(y, x)), height(lat[0], p, z, a, e2)]


def height(lat: Column, p: Column, z: Column, a: float, e2: float) -> Column:
    s, c = F.sin(lat), F.cos(lat)
    return p * c + z * s - a * F.sqrt(1 - e2 * s * s)


def enu_basis(lat_deg: Column, lon_deg: Column) -> list[list[Column]]:
    """Unit vectors east, north and up in body-fixed axes."""
    lat, lon = F.radians(lat_deg), F.radians(lon_deg)
    sl, cl, so, co = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    return [[-so, co, F.lit(0.0)], [-sl * co, -sl * so, cl], [cl * co, cl * so, sl]]


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_R_KM) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((b - a) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), s * s + F.cos(a) * F.cos(b) * t * t)))


def along_great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, t: Column) -> tuple[Column, Column]:
    """Latitude and longitude the part t of the way."""
    d = great_circle_km(lat1, lon1, lat2, lon2, 1.0)
    a, b = (F.when(d < 1e-12, w0).otherwise(F.sin(w * d) / F.sin(d)) for w0, w in ((1 - t, 1 - t), (t, t)))
    la, lb, oa, ob = F.radians(lat1), F.radians(lat2), F.radians(lon1), F.radians(lon2)
    x = a * F.cos(la) * F.cos(oa) + b * F.cos(lb) * F.cos(ob)
    y = a * F.cos(la) * F.sin(oa) + b * F.cos(lb) * F.sin(ob)
    z = a * F.sin(la) + b * F.sin(lb)
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def hermite(p0: Column, v0: Column, p1: Column, v1: Column, t: Column, span: Column) -> Column:
    """The cubic through p0 and p1 with the slopes v0 and v1 (per unit of span), the part t of the way."""
    return (1 + 2 * t) * (1 - t) * (1 - t) * p0 + t * (1 - t) * (1 - t) * span * v0 + t * t * (3 - 2 * t) * p1 + t * t * (t - 1) * span * v1


def wrap180(deg: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(deg + 180, F.lit(360.0)) - 180


def bearing_deg(dx: Column, dy: Column) -> Column:
    """The compass bearing of (east, north)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a closed ring, an array of (x, y) arrays, by the parity of crossings to its right."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, F.when(i + 1 == n, F.lit(0)).otherwise(i + 1))
        px, py, qx, qy = F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(q, F.lit(0)), F.get(q, F.lit(1))
        return F.when((py > y) != (qy > y), (x < (qx - px) * (y - py) / (qy - py) + px)).otherwise(F.lit(False))

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Inside the first ring and none of the others, its holes."""
    inside = F.transform(rings, lambda r: in_ring(x, y, r))
    return F.get(inside, F.lit(0)) & ~F.exists(F.slice(inside, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda v: v)


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the nearest point of a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / length)))
    ex, ey = ax + t * dx - x, ay + t * dy - y
    return F.sqrt(ex * ex + ey * ey)


def segments_cross(a: list[Column], b: list[Column], c: list[Column], d: list[Column]) -> Column:
    """Whether segments a-b and c-d cross at a point inside both."""

    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def plane_through(direction: Column, inclination_deg: float, ascending: bool = True) -> tuple[Column, Column]:
    """(node, argument of latitude) in degrees of the orbit plane of an inclination that holds a direction, passed northbound or southbound; not a number where no such plane is.

    The plane's normal n has z = cos i and is at right angles to the direction d, so its level part lies on a line:
    along the level part of d it measures -z cos i / |level d|, and across it what is left of sin i.
    """
    from wherewhen.functions.quat import at, norm

    x, y, z = (c / norm(direction) for c in at(direction, 3))
    cos_i, sin_i = math.cos(math.radians(inclination_deg)), math.sin(math.radians(inclination_deg))
    flat = F.hypot(x, y)
    along = -z * cos_i / flat
    across = F.sqrt(F.lit(sin_i * sin_i) - along * along) * (-1.0 if ascending else 1.0)
    nx, ny = (along * x - across * y) / flat, (along * y + across * x) / flat
    # the node, at right angles to the normal's level part, and how far d is from it around the normal
    lead = (-ny * x + nx * y) / sin_i
    swept = F.atan2(z / sin_i, lead)
    turn = lambda c: F.pmod(F.degrees(c), F.lit(360.0))
    return turn(F.atan2(nx, -ny)), turn(swept)


def lvlh(normal: Column, r: Column) -> list[Column]:
    """Axes at r that look down: along the track, against the orbit's normal, to the centre. The track is at right
    angles to normal and r; the other two follow from it."""
    from wherewhen.functions.quat import cross, norm, scale

    ahead = cross(normal, r)
    ahead, down = scale(ahead, 1 / norm(ahead)), scale(r, -1 / norm(r))
    return [ahead, cross(down, ahead), down]


def vehicle_axes(lat_deg: Column, lon_deg: Column, heading: Column, pitch: Column) -> list[list[Column]]:
    """Forward, right and down in body-fixed axes, for a heading clockwise from north and a climb, in radians: the
    level axes turned by the heading, then tipped about the right one."""
    east, north, up = enu_basis(lat_deg, lon_deg)
    mixed = lambda a, u, b, v: [a * p + b * q for p, q in zip(u, v, strict=True)]
    level = mixed(F.sin(heading), east, F.cos(heading), north)
    right = mixed(F.cos(heading), east, -F.sin(heading), north)
    return [mixed(F.cos(pitch), level, F.sin(pitch), up), right, mixed(F.sin(pitch), level, -F.cos(pitch), up)]
