"""Scalar expressions over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def clip01(x: Column) -> Column:
    return clip(x, 0, 1)


def smoothstep01(x: Column) -> Column:
    t = clip01(x)
    return t * t * (3 - 2 * t)


def smooth_max(*xs: Column) -> Column:
    """Probabilistic or: 1 - product of (1 - x)."""
    return 1 - reduce(lambda a, b: a * b, [1 - clip01(x) for x in xs])


def count_confidence(n: Column, least: float) -> Column:
    return clip01(n / float(least))


def safe_positive(x: Column, fallback: Column) -> Column:
    return F.when(finite(x) > 0, x).otherwise(fallback)


def log_transform(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def inverse_log_transform(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def logit_clamped(x: Column, eps: float = 1e-6) -> Column:
    p = clip(x, eps, 1 - eps)
    return F.log(p / (1 - p))


def huber(error: Column, delta: float) -> Column:
    e = F.abs(error)
    return F.when(e <= delta, 0.5 * e * e / delta).otherwise(e - 0.5 * delta)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def unit(v: Column, eps: float = 1e-12) -> Column:
    """An array divided by its norm; zero arrays stay zero."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(n, F.lit(eps)))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def triangle_area(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    n = cross([y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, c, strict=True)])
    return 0.5 * F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])


def quantize(x: Column, low: Column, high: Column, bits: int) -> Column:
    """Min-max code of `bits` bits, half to even; a constant column codes as 0."""
    return F.when(high > low, F.rint((x - low) / (high - low) * ((1 << bits) - 1))).otherwise(0.0).cast("long")


def dequantize(code: Column, low: Column, high: Column, bits: int) -> Column:
    return low + code / float((1 << bits) - 1) * (high - low)
