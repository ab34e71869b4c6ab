"""Quaternions [w, x, y, z], vectors and rigid motions as column expressions.

A motion is a struct (t, q): p -> q p q* + t.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0)


def at(v: Column, n: int) -> list[Column]:
    return [F.get(v, F.lit(i)) for i in range(n)]


def vector(*x) -> Column:
    return F.array(*[c if isinstance(c, Column) else F.lit(float(c)) for c in x])


def mul(a: Column, b: Column) -> Column:
    aw, ax, ay, az = at(a, 4)
    bw, bx, by, bz = at(b, 4)
    return vector(aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def conj(q: Column) -> Column:
    w, x, y, z = at(q, 4)
    return vector(w, -x, -y, -z)


def norm(v: Column, n: int = 3) -> Column:
    return F.sqrt(sum((x * x for x in at(v, n)), F.lit(0.0)))


def normalise(q: Column) -> Column:
    size = norm(q, 4)
    return vector(*[x / size for x in at(q, 4)])


def cross(a: Column, b: Column) -> Column:
    ax, ay, az = at(a, 3)
    bx, by, bz = at(b, 3)
    return vector(ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx)


def dot(a: Column, b: Column, n: int = 3) -> Column:
    return sum((x * y for x, y in zip(at(a, n), at(b, n), strict=True)), F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return vector(*[x + y for x, y in zip(at(a, 3), at(b, 3), strict=True)])


def sub(a: Column, b: Column) -> Column:
    return vector(*[x - y for x, y in zip(at(a, 3), at(b, 3), strict=True)])


def scale(a: Column, k: Column) -> Column:
    return vector(*[x * k for x in at(a, 3)])


def rotate(q: Column, v: Column) -> Column:
    """q v q* for a unit quaternion: v + 2 w (u x v) + 2 u x (u x v)."""
    w, x, y, z = at(q, 4)
    vx, vy, vz = at(v, 3)
    cx, cy, cz = y * vz - z * vy, z * vx - x * vz, x * vy - y * vx
    return vector(vx + 2 * (w * cx + y * cz - z * cy), vy + 2 * (w * cy + z * cx - x * cz), vz + 2 * (w * cz + x * cy - y * cx))


def yaw(angle: Column) -> Column:
    """The turn by an angle about z."""
    return vector(F.cos(angle / 2), 0, 0, F.sin(angle / 2))


def heading(q: Column) -> Column:
    """The angle about z that a quaternion turns x by."""
    w, x, y, z = at(q, 4)
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def matrix(q: Column) -> list[list[Column]]:
    w, x, y, z = at(q, 4)
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]


def from_matrix(m: list[list[Column]]) -> Column:
    """The quaternion of a rotation matrix, from its largest component, for stability."""
    trace = m[0][0] + m[1][1] + m[2][2]

    def by(size: Column, *num: Column) -> Column:
        s = F.sqrt(size) * 2
        return vector(*[s / 4 if x is None else x / s for x in num])

    w = by(trace + 1, None, m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1])
    x = by(1 + m[0][0] - m[1][1] - m[2][2], m[2][1] - m[1][2], None, m[0][1] + m[1][0], m[0][2] + m[2][0])
    y = by(1 - m[0][0] + m[1][1] - m[2][2], m[0][2] - m[2][0], m[0][1] + m[1][0], None, m[1][2] + m[2][1])
    z = by(1 - m[0][0] - m[1][1] + m[2][2], m[1][0] - m[0][1], m[0][2] + m[2][0], m[1][2] + m[2][1], None)
    return F.when(trace > 0, w).when((m[0][0] > m[1][1]) & (m[0][0] > m[2][2]), x).when(m[1][1] > m[2][2], y).otherwise(z)


def slerp(a: Column, b: Column, t: Column) -> Column:
    """The turn part of the way from a to b, the shorter way; near-equal turns are blended straight."""
    d = dot(a, b, 4)
    sign = F.when(d < 0, -1.0).otherwise(1.0)
    near = F.least(F.abs(d), F.lit(1.0))
    angle = F.acos(near)
    wa = F.when(near > 0.9995, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = F.when(near > 0.9995, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    return normalise(vector(*[wa * x + wb * y for x, y in zip(at(a, 4), at(b, 4), strict=True)]))


def motion(t: Column, q: Column) -> Column:
    return F.struct(t.alias("t"), q.alias("q"))


def apply(m: Column, p: Column) -> Column:
    return add(rotate(m["q"], p), m["t"])


def compose(outer: Column, inner: Column) -> Column:
    """First inner, then outer."""
    return motion(apply(outer, inner["t"]), mul(outer["q"], inner["q"]))
