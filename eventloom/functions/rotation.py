"""Rotations as plain column arithmetic. Quaternions are (w, x, y, z) tuples of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586
PI = 3.141592653589793


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def wrap(c: Column) -> Column:
    """Angle into [-pi, pi)."""
    return F.pmod(c + PI, F.lit(TWO_PI)) - PI


def euler(q, wrapped: bool = True) -> list[Column]:
    """roll, pitch, yaw; roll and yaw taken mod 2 pi."""
    w, x, y, z = q
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(clip(2 * (w * y - z * x), -1, 1))
    yaw = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    if wrapped:
        roll, yaw = F.pmod(roll, F.lit(TWO_PI)), F.pmod(yaw, F.lit(TWO_PI))
    return [roll, pitch, yaw]


def rotvec(q) -> list[Column]:
    """Axis times angle; zero for no rotation."""
    w = clip(q[0], -1, 1)
    den = F.sqrt(1 - w * w)
    angle = 2 * F.acos(w)
    return [F.when(den < 1e-8, F.lit(0.0)).otherwise(a / den * angle) for a in q[1:]]


def from_euler(r) -> list[Column]:
    """Euler xyz to quaternion; roll and yaw are wrapped to [-pi, pi) first."""
    roll, pitch, yaw = wrap(r[0]), r[1], wrap(r[2])
    cr, sr, cp, sp, cy, sy = (f(a / 2) for a in (roll, pitch, yaw) for f in (F.cos, F.sin))
    return [
        cr * cp * cy + sr * sp * sy,
        sr * cp * cy - cr * sp * sy,
        cr * sp * cy + sr * cp * sy,
        cr * cp * sy - sr * sp * cy,
    ]


def from_rotvec(v) -> list[Column]:
    a = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    s = F.when(a < 1e-12, F.lit(0.5)).otherwise(F.sin(a / 2) / a)
    return [F.cos(a / 2), v[0] * s, v[1] * s, v[2] * s]


def mul(a, b) -> list[Column]:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return [
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    ]


def conj(q) -> list[Column]:
    return [q[0], -q[1], -q[2], -q[3]]


def rotate(q, v) -> list[Column]:
    w, x, y, z = q
    tx, ty, tz = 2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0])
    return [v[0] + w * tx + y * tz - z * ty, v[1] + w * ty + z * tx - x * tz, v[2] + w * tz + x * ty - y * tx]


def rotate_inv(q, v) -> list[Column]:
    """A vector seen from a frame with orientation q."""
    return rotate(conj(q), v)


def norm(v) -> Column:
    s = v[0] * v[0]
    for c in v[1:]:
        s = s + c * c
    return F.sqrt(s)


def sub(a, b) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def direction_index(vx: Column, vy: Column) -> Column:
    """Eight unequal sectors: 30 degrees around the axes, 60 between them."""
    a = F.pmod(F.degrees(F.atan2(vy, vx)), F.lit(360.0))
    e = F.when((a >= 345) | (a < 15), 0)
    for i, hi in enumerate((75, 105, 165, 195, 255, 285, 345), 1):
        e = e.when(a < hi, i)
    return e.cast("int")
