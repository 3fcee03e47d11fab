"""Rotation algebra as Column expressions.

A rotation is a unit quaternion ``(w, x, y, z)`` held in four columns: sixteen multiplications compose
two of them, against twenty-seven for matrices, and the generated code stays small enough for the JIT.
Euler triples are ZXZ and ordered ``(phi, psi, theta)`` with ``R = Rz(psi) Rx(theta) Rz(phi)``; they are
rounded half-even to four decimals whenever they are read off a rotation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMALS = 4
POLE = 1e-7  # fixed value: below this 1 - R22 counts as "no tilt"


class Quat(NamedTuple):
    w: Column
    x: Column
    y: Column
    z: Column

    def conj(self) -> "Quat":
        return Quat(self.w, -self.x, -self.y, -self.z)

    def columns(self, prefix: str) -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip(self, "wxyz")]


class Vec(NamedTuple):
    x: Column
    y: Column
    z: Column

    def minus(self, o: "Vec") -> "Vec":
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def plus(self, o: "Vec") -> "Vec":
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def scale(self, s: Column) -> "Vec":
        return Vec(self.x * s, self.y * s, self.z * s)

    def norm(self) -> Column:
        return F.sqrt(self.x * self.x + self.y * self.y + self.z * self.z)


def quat_cols(prefix: str) -> Quat:
    return Quat(*(F.col(prefix + n) for n in "wxyz"))


def vec_cols(names: list[str]) -> Vec:
    return Vec(*(F.col(n) for n in names))


def positive_zero(c: Column) -> Column:
    return c + F.lit(0.0)


def round_half_even(c: Column) -> Column:
    """Rounded to ``DECIMALS`` digits in plain arithmetic; ``bround`` goes through a decimal number for every value."""
    scale = 10.0 ** DECIMALS
    return positive_zero(F.rint(c * F.lit(scale)) / F.lit(scale))


def round_half_up(c: Column, digits: int) -> Column:
    """Rounded to ``digits`` digits, halves away from zero, in plain arithmetic like :func:`round_half_even`."""
    c, scale = c.cast("double"), 10.0 ** digits
    scaled = c * F.lit(scale)
    whole = F.rint(scaled)
    half = F.when((scaled - whole == 0.5) & (c > 0), 1.0).when((scaled - whole == -0.5) & (c < 0), -1.0).otherwise(0.0)
    return positive_zero((whole + half) / F.lit(scale))


def quat_from_zxz(phi: Column, psi: Column, theta: Column) -> Quat:
    half = F.radians(theta) / 2
    s, d = F.radians(psi + phi) / 2, F.radians(psi - phi) / 2
    return Quat(F.cos(half) * F.cos(s), F.sin(half) * F.cos(d), F.sin(half) * F.sin(d), F.cos(half) * F.sin(s))


def quat_from_zyz(rot: Column, tilt: Column, psi: Column) -> Quat:
    """Rotation of a ZYZ triple in the file convention: ``Rz(-psi) Ry(-tilt) Rz(-rot)``."""
    half = F.radians(-tilt) / 2
    s, d = F.radians(-psi - rot) / 2, F.radians(-psi + rot) / 2
    return Quat(F.cos(half) * F.cos(s), -F.sin(half) * F.sin(d), F.sin(half) * F.cos(d), F.cos(half) * F.sin(s))


def compose(a: Quat, b: Quat) -> Quat:
    """Rotation ``a`` after ``b``."""
    return Quat(
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
    )


def rotate(q: Quat, v: Vec) -> Vec:
    tx = (q.y * v.z - q.z * v.y) * 2
    ty = (q.z * v.x - q.x * v.z) * 2
    tz = (q.x * v.y - q.y * v.x) * 2
    return Vec(
        v.x + q.w * tx + (q.y * tz - q.z * ty),
        v.y + q.w * ty + (q.z * tx - q.x * tz),
        v.z + q.w * tz + (q.x * ty - q.y * tx),
    )


def _clamped_acos(c: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def zxz_from_quat(q: Quat) -> list[Column]:
    """``[phi, psi, theta]`` in degrees, rounded; without tilt the whole turn is reported as phi."""
    r22 = 1 - (q.x * q.x + q.y * q.y) * 2
    flat = F.abs(r22 - 1) < POLE
    turn = F.atan2((q.x * q.y + q.w * q.z) * 2, 1 - (q.y * q.y + q.z * q.z) * 2)
    phi = F.when(flat, turn).otherwise(F.atan2(q.x * q.z - q.w * q.y, q.y * q.z + q.w * q.x))
    psi = F.when(flat, F.lit(0.0)).otherwise(F.atan2(q.x * q.z + q.w * q.y, q.w * q.x - q.y * q.z))
    theta = F.when(flat, F.lit(0.0)).otherwise(_clamped_acos(r22))
    return [round_half_even(F.degrees(phi)), round_half_even(F.degrees(psi)), round_half_even(theta)]


def zyz_from_quat(q: Quat) -> list[Column]:
    """``[rot, tilt, psi]`` of the file convention for the rotation ``Rz(psi) Rx(theta) Rz(phi)``."""
    r22 = 1 - (q.x * q.x + q.y * q.y) * 2
    flat = F.abs(r22 - 1) < POLE
    turn = F.atan2((q.x * q.y - q.w * q.z) * 2, 1 - (q.y * q.y + q.z * q.z) * 2)
    rot = F.when(flat, F.lit(0.0)).otherwise(F.atan2(q.y * q.z + q.w * q.x, q.x * q.z - q.w * q.y))
    tilt = F.when(flat, F.lit(0.0)).otherwise(_clamped_acos(r22))
    psi = F.when(flat, turn).otherwise(F.atan2(q.y * q.z - q.w * q.x, -(q.x * q.z + q.w * q.y)))
    return [round_half_even(F.degrees(rot)), round_half_even(tilt), round_half_even(F.degrees(psi))]


def zyz_to_zxz(rot: Column, tilt: Column, psi: Column) -> list[Column]:
    return zxz_from_quat(quat_from_zyz(rot, tilt, psi))


def zxz_to_zyz(phi: Column, psi: Column, theta: Column) -> list[Column]:
    return zyz_from_quat(quat_from_zxz(phi, psi, theta))


def inverse_zxz(phi: Column, psi: Column, theta: Column) -> list[Column]:
    return [-psi, -phi, -theta]


def turn_angle(w: Column) -> Column:
    """Rotation magnitude in degrees, 0..180, from the scalar part of the quaternion."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(w)))) * 2


def zxz_magnitude(phi: Column, psi: Column, theta: Column) -> Column:
    return turn_angle(F.cos(F.radians(theta) / 2) * F.cos(F.radians(psi + phi) / 2))


def angular_distance(a: Quat, b: Quat) -> Column:
    return turn_angle(a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z)


def matrix_columns(q: Quat, prefix: str = "r") -> list[Column]:
    """The nine matrix elements ``r00..r22``."""
    two = F.lit(2.0)
    cells = [
        [1 - two * (q.y * q.y + q.z * q.z), two * (q.x * q.y - q.w * q.z), two * (q.x * q.z + q.w * q.y)],
        [two * (q.x * q.y + q.w * q.z), 1 - two * (q.x * q.x + q.z * q.z), two * (q.y * q.z - q.w * q.x)],
        [two * (q.x * q.z - q.w * q.y), two * (q.y * q.z + q.w * q.x), 1 - two * (q.x * q.x + q.y * q.y)],
    ]
    return [cells[i][j].alias(f"{prefix}{i}{j}") for i in range(3) for j in range(3)]


def quat_from_matrix(prefix: str = "r") -> Quat:
    """Unit quaternion with non-negative scalar part of the matrix columns ``<prefix>00..22``.

    The largest component is taken from the diagonal, the other three from sums and differences, so the
    division never meets a small number.
    """
    r = [[F.col(f"{prefix}{i}{j}") for j in range(3)] for i in range(3)]
    squares = [
        1 + r[0][0] + r[1][1] + r[2][2],
        1 + r[0][0] - r[1][1] - r[2][2],
        1 - r[0][0] + r[1][1] - r[2][2],
        1 - r[0][0] - r[1][1] + r[2][2],
    ]
    wx, wy, wz = r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]
    xy, xz, yz = r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1]
    rows = [
        [squares[0], wx, wy, wz],
        [wx, squares[1], xy, xz],
        [wy, xy, squares[2], yz],
        [wz, xz, yz, squares[3]],
    ]
    top = F.greatest(*squares)
    parts = []
    for part in range(4):
        value = rows[3][part]
        for lead in (2, 1, 0):
            value = F.when(squares[lead] >= top, rows[lead][part]).otherwise(value)
        parts.append(value / (F.sqrt(top) * 2))
    sign = F.when(parts[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return Quat(*(p * sign for p in parts))


def scaled_shift(shift: Column, radius: float | Column) -> Column:
    """Translation distance expressed in degrees: the full search diameter is half a turn."""
    return shift / (F.lit(2.0) * radius) * F.lit(180.0)


def combined_distance(shift: Column, angle: Column, radius: float | Column, metric: str = "scale2Ang") -> Column:
    weight = {"scale2Ang": 1.0, "scale2AngFudge": 2.0}
    if metric not in weight:
        raise ValueError(f"unknown row-wise metric {metric!r}")
    return (angle + scaled_shift(shift, radius) * F.lit(weight[metric])) / F.lit(2.0)


def shift_bound(distance: float, radius: float, metric: str = "scale2Ang") -> float:
    """Largest translation difference a combined distance of ``distance`` can hide.

    The rotation part is never negative, so every candidate within ``distance`` also lies inside this
    ball: it turns an all-pairs comparison into a range join without losing a row.
    """
    return 2.0 * distance * 2.0 * radius / 180.0 / {"scale2Ang": 1.0, "scale2AngFudge": 2.0}[metric]
