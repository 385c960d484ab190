"""One frame for a set of cameras: turned so that they stand upright, centred and scaled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROTATION = [f"r{i}{j}" for i in range(3) for j in range(3)]
PLACE = ["tx", "ty", "tz"]


def similarity(cameras: DataFrame, strict: bool = False, center: str = "focus") -> DataFrame:
    """One row m00 to m23 and scale: the transform that turns the mean up axis of cameras (r00 to r22, tx, ty, tz: camera
    to world, y down) to -y, moves the middle to 0 and scales camera distances to 1: the median one, or if strict the
    largest. The middle is the median, by axis, of camera places ('poses') or of the places on their lines of sight
    that are nearest to 0 ('focus'). A mean up axis of exactly +y mirrors x instead. Sums and medians are
    aggregations; what is broadcast is a row. No cameras give a row of nulls."""
    if center not in ("focus", "poses"):
        raise ValueError(f"center is focus or poses, not {center}")
    up = cameras.agg(*[(-F.avg(f"r{i}1")).alias(f"u{i}") for i in range(3)])
    size = F.sqrt(sum((F.col(f"u{i}") ** 2 for i in range(3)), F.lit(0.0)))
    up = up.select(*[(F.col(f"u{i}") / size).alias(f"u{i}") for i in range(3)])
    ux, uy, uz = (F.col(f"u{i}") for i in range(3))
    c = -uy
    # the turn about up x (0, -1, 0) = (uz, 0, -ux): I + K + K K / (1 + c)
    k = [[F.lit(0.0), ux, F.lit(0.0)], [-ux, F.lit(0.0), -uz], [F.lit(0.0), uz, F.lit(0.0)]]
    square = [[sum((k[i][m] * k[m][j] for m in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    half = [[-1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]  # x is mirrored, y stays
    turn = [F.when(c > -1, F.lit(float(i == j)) + k[i][j] + square[i][j] / (1 + c)).otherwise(half[i][j]).alias(f"a{i}{j}") for i in range(3) for j in range(3)]
    turn = up.select(*turn)
    x = cameras.select(*ROTATION, *PLACE).join(F.broadcast(turn))  # one row
    row = lambda i, v: sum((F.col(f"a{i}{m}") * v[m] for m in range(3)), F.lit(0.0))
    t, ahead = [F.col(c) for c in PLACE], [F.col(f"r{i}2") for i in range(3)]
    x = x.select(*[row(i, t).alias(f"t{i}") for i in range(3)], *[row(i, ahead).alias(f"f{i}") for i in range(3)])
    along = sum((F.col(f"f{i}") * F.col(f"t{i}") for i in range(3)), F.lit(0.0))
    middle = [F.median(F.col(f"t{i}") - along * F.col(f"f{i}") if center == "focus" else F.col(f"t{i}")).alias(f"c{i}") for i in range(3)]
    mid = x.agg(*middle)
    away = F.sqrt(sum(((F.col(f"t{i}") - F.col(f"c{i}")) ** 2 for i in range(3)), F.lit(0.0)))
    far = x.join(F.broadcast(mid)).agg((1 / (F.max(away) if strict else F.median(away))).alias("scale"))  # one row
    one = turn.join(F.broadcast(mid)).join(F.broadcast(far))  # one row each
    linear = [(F.col(f"a{i}{j}") * F.col("scale")).alias(f"m{i}{j}") for i in range(3) for j in range(3)]
    return one.select(*linear, *[(-F.col(f"c{i}") * F.col("scale")).alias(f"m{i}3") for i in range(3)], "scale")


def moved(points: DataFrame, transform: DataFrame) -> DataFrame:
    """points with x, y, z in the frame of similarity()'s row."""
    x = points.join(F.broadcast(transform))  # one row
    at = [sum((F.col(f"m{i}{j}") * F.col(c) for j, c in enumerate("xyz")), F.col(f"m{i}3")) for i in range(3)]
    return x.withColumns({f"_{c}": a for c, a in zip("xyz", at, strict=True)}).select(*[F.col(f"_{c}").alias(c) if c in ("x", "y", "z") else F.col(c) for c in points.columns])
