"""Expressions on three-component vectors, given as lists of columns, and on symmetric 3 x 3 matrices."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]


def of(struct: str) -> Vector:
    return [F.col(f"{struct}.{c}") for c in "xyz"]


def sub(a: Vector, b: Vector) -> Vector:
    return [x - y for x, y in zip(a, b, strict=True)]


def add(a: Vector, b: Vector) -> Vector:
    return [x + y for x, y in zip(a, b, strict=True)]


def scale(a: Vector, k: Column) -> Vector:
    return [x * k for x in a]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def divide(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def closest_on_triangle(p: Vector, a: Vector, b: Vector, c: Vector) -> tuple[Column, Column, Column]:
    """Barycentric weights of the point of a triangle that is closest to p: its foot on the plane if that lies inside,
    else the nearest of the feet on the three sides, each kept between its ends. Sides without length have their first
    end, triangles without area are their sides."""
    side_b, side_c, to_p = sub(b, a), sub(c, a), sub(p, a)
    up = cross(side_b, side_c)
    size = dot(up, up)
    in_b, in_c = divide(dot(cross(to_p, side_c), up), size), divide(dot(cross(side_b, to_p), up), size)
    on_plane = F.struct((1 - in_b - in_c).alias("wa"), in_b.alias("wb"), in_c.alias("wc"))
    on_side = []
    for k, (u, v) in enumerate(((a, b), (b, c), (c, a))):
        along = sub(v, u)
        t = F.greatest(F.least(divide(dot(sub(p, u), along), dot(along, along)), F.lit(1.0)), F.lit(0.0))
        away = sub(p, add(u, scale(along, t)))
        w = [F.lit(0.0)] * 3
        w[k], w[(k + 1) % 3] = 1 - t, t
        on_side.append(F.struct(dot(away, away).alias("d2"), F.lit(k).alias("k"), F.struct(*[x.alias(n) for x, n in zip(w, ("wa", "wb", "wc"), strict=True)]).alias("w")))
    inside = (size > 0) & (in_b >= 0) & (in_c >= 0) & (in_b + in_c <= 1)
    found = F.when(inside, on_plane).otherwise(F.least(*on_side)["w"])
    return found["wa"], found["wb"], found["wc"]


def distance_to_triangle(p: Vector, a: Vector, b: Vector, c: Vector) -> Column:
    u, v, w = closest_on_triangle(p, a, b, c)
    return norm(sub(p, add(add(scale(a, u), scale(b, v)), scale(c, w))))


def z_order(cells: list[Column], bits: int) -> Column:
    """One number of the cells' lowest bits, in turns, so that near cells have near numbers mostly."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate(cells):
            out = out + F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(cells) + k)
    return out


def angle(cosine: Column) -> Column:
    """Of two directions without sense, as a share of a right angle."""
    return F.acos(F.least(F.abs(cosine), F.lit(1.0))) / (math.pi / 2)
