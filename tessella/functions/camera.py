"""Camera expressions: pinhole projection, real spherical harmonics, colour and covariance columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

def pinhole(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float, width: int, height: int, near: float) -> tuple[Column, Column]:
    """Pixel (u, v) of a point in camera space, rounded half to even; -1 where it is not nearer than `near` allows or
    falls outside the image."""
    u, v = F.rint(x / z * fx + cx), F.rint(y / z * fy + cy)
    seen = (z > near) & u.between(0, width - 1) & v.between(0, height - 1)
    return F.when(seen, u).otherwise(-1).cast("int"), F.when(seen, v).otherwise(-1).cast("int")


def harmonics(x: Column, y: Column, z: Column, degree: int) -> list[Column]:
    """The real basis up to a degree along the unit vector (x, y, z), in order of degree and index, with the sign (-1) ** m
    of an order m. Powers of (x + iy) give the sines and cosines of each order, Legendre's recurrence the rest."""
    cos, sin = [F.lit(1.0)], [F.lit(0.0)]
    for _ in range(degree):
        cos.append(x * cos[-1] - y * sin[-1])
        sin.append(x * sin[-1] + y * cos[-2])
    # p[l, m]: the associated Legendre function over sin ** m, without its sign
    p = {}
    for m in range(degree + 1):
        p[m, m] = F.lit(float(math.prod(range(1, 2 * m, 2))))
        for l in range(m + 1, degree + 1):  # noqa: E741
            low = p.get((l - 2, m))
            p[l, m] = ((2 * l - 1) * z * p[l - 1, m] - (l + m - 1) * low) / (l - m) if low is not None else (2 * l - 1) * z * p[l - 1, m]
    out = []
    for l in range(degree + 1):  # noqa: E741
        for m in range(-l, l + 1):
            k = abs(m)
            factor = math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - k) / math.factorial(l + k)) * (math.sqrt(2) * (-1) ** k if m else 1.0)
            out.append(factor * p[l, k] * (sin[k] if m < 0 else cos[k]))
    return out


def rgb_to_sh(c: Column) -> Column:
    return (c - 0.5) / (0.5 / math.sqrt(math.pi))


def covariance(q: list[Column], s: list[Column]) -> list[Column]:
    """Upper triangle xx, xy, xz, yy, yz, zz of R S S R' from a quaternion (w, x, y, z), unit or not, and scales."""
    n = q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3]
    w, x, y, z = q
    r = [[1 - 2 * (y * y + z * z) / n, 2 * (x * y - w * z) / n, 2 * (x * z + w * y) / n],
         [2 * (x * y + w * z) / n, 1 - 2 * (x * x + z * z) / n, 2 * (y * z - w * x) / n],
         [2 * (x * z - w * y) / n, 2 * (y * z + w * x) / n, 1 - 2 * (x * x + y * y) / n]]
    return [sum((r[i][k] * r[j][k] * s[k] * s[k] for k in range(1, 3)), r[i][0] * r[j][0] * s[0] * s[0]) for i in range(3) for j in range(i, 3)]
