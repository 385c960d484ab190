"""Plane fits: weighted principal axes of groups of points, by sums and a closed form of the smallest eigenvalue."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.staging import stage, unstage


def fit(df: DataFrame, keys: list[str], weight: str, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """keys, n, weight, cx, cy, cz (centroid), variance (across the plane), nx, ny, nz, d. The normal's largest
    component is positive; a group without a unique plane (fewer than three points, or on a line) has a null normal.
    Two aggregations, so that the moments are taken about the centroid."""
    w, c = F.col(weight), [F.col(a) for a in xyz]
    mean = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("_w"), *[(F.sum(w * a) / F.sum(w)).alias(f"c{b}") for a, b in zip(c, "xyz", strict=True)])
    at = [F.col(a) - F.col(f"c{b}") for a, b in zip(xyz, "xyz", strict=True)]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    x = df.join(mean, keys).groupBy(*keys, "n", "_w", "cx", "cy", "cz").agg(*[(F.sum(w * at[i] * at[j]) / F.col("_w")).alias(f"_{i}{j}") for i, j in pairs])
    m = lambda i, j: F.col(f"_{min(i, j)}{max(i, j)}")
    x = x.withColumn("_q", (m(0, 0) + m(1, 1) + m(2, 2)) / 3)
    p2 = sum(((m(i, i) - F.col("_q")) ** 2 for i in range(3)), F.lit(0.0)) + 2 * (m(0, 1) ** 2 + m(0, 2) ** 2 + m(1, 2) ** 2)
    x = x.withColumn("_p", F.sqrt(p2 / 6))
    b = lambda i, j: (m(i, j) - F.col("_q") if i == j else m(i, j)) / F.col("_p")
    det = b(0, 0) * (b(1, 1) * b(2, 2) - b(1, 2) ** 2) - b(0, 1) * (b(0, 1) * b(2, 2) - b(1, 2) * b(0, 2)) + b(0, 2) * (b(0, 1) * b(1, 2) - b(1, 1) * b(0, 2))
    angle = F.acos(F.greatest(F.least(det / 2, F.lit(1.0)), F.lit(-1.0))) / 3
    low = F.col("_q") + 2 * F.col("_p") * F.cos(angle + 2 * math.pi / 3)
    x = x.withColumn("variance", F.when(F.col("_p") > 0, F.greatest(low, F.lit(0.0))).otherwise(F.col("_q")))
    row = lambda i: [m(i, j) - (F.col("variance") if i == j else 0.0) for j in range(3)]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    sized = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        v = cross(row(i), row(j))
        sized.append(F.struct((v[0] ** 2 + v[1] ** 2 + v[2] ** 2).alias("s"), *[a.alias(f"v{k}") for k, a in enumerate(v)]))
    x = x.withColumn("_v", F.greatest(*sized))
    peak = F.greatest(*[F.struct(F.abs(F.col("_v")[f"v{k}"]).alias("a"), F.signum(F.col("_v")[f"v{k}"]).alias("s")) for k in range(3)])
    ok = F.col("_v.s") > 1e-12 * F.col("_p") ** 4
    x = x.select(*keys, "n", F.col("_w").alias("weight"), "cx", "cy", "cz", "variance", *[F.when(ok, F.col("_v")[f"v{k}"] / F.sqrt("_v.s") * peak["s"]).alias(f"n{a}") for k, a in enumerate("xyz")])
    return x.withColumn("d", -(F.col("nx") * F.col("cx") + F.col("ny") * F.col("cy") + F.col("nz") * F.col("cz")))


def dominant_direction(df: DataFrame, six: tuple[str, ...] = ("xx", "xy", "xz", "yy", "yz", "zz")) -> DataFrame:
    """df (a symmetric matrix's upper triangle) with top, its largest eigenvalue in closed form, and vx, vy, vz, the unit
    eigenvector with a positive largest component; null where no direction stands out. Column by column, so that no
    expression holds another many times."""
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in six)
    m = [[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]
    x = df.withColumn("_q", (xx + yy + zz) / 3)
    q = F.col("_q")
    x = x.withColumn("_p", F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6))
    p = F.col("_p")
    b = [[m[i][j] - q if i == j else m[i][j] for j in range(3)] for i in range(3)]
    x = x.withColumn("_h", V.dot(b[0], V.cross(b[1], b[2])) / (p * p * p) / 2)
    x = x.withColumn("top", F.when(p > 0, q + 2 * p * F.cos(F.acos(F.greatest(F.least(F.col("_h"), F.lit(1.0)), F.lit(-1.0))) / 3)).otherwise(q))
    rows = [[m[i][j] - F.col("top") if i == j else m[i][j] for j in range(3)] for i in range(3)]
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for k, c in enumerate(V.cross(rows[i], rows[j])):
            x = x.withColumn(f"_v{n}{k}", c)
    v = lambda n, k: F.col(f"_v{n}{k}")
    x = x.withColumn("_v", F.greatest(*[F.struct((v(n, 0) * v(n, 0) + v(n, 1) * v(n, 1) + v(n, 2) * v(n, 2)).alias("s"), *[v(n, k).alias(f"v{k}") for k in range(3)]) for n in range(3)]))
    sign = F.greatest(*[F.struct(F.abs(F.col(f"_v.v{k}")).alias("a"), F.signum(F.col(f"_v.v{k}")).alias("s")) for k in range(3)])["s"]
    ok = F.col("_v.s") > 1e-12 * p * p * p * p
    out = [F.when(ok, F.col(f"_v.v{k}") / F.sqrt("_v.s") * sign).alias(f"v{c}") for k, c in enumerate("xyz")]
    return x.select(*df.columns, "top", *out)


def _found(df: DataFrame, keys: list[str]) -> DataFrame:
    """fit() with weights w, staged, without groups that have no plane: a filter on its normals before they are written
    would repeat their whole expressions."""
    return stage(fit(df, keys, "w"), "planes").filter("nx is not null")


def _away(df: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """df with `away`, the distance of x, y, z to its group's plane."""
    at = sum((F.col(f"n{a}") * (F.col(a) - F.col(f"c{a}")) for a in "xyz"), F.lit(0.0))
    return df.join(planes.select(*keys, "cx", "cy", "cz", "nx", "ny", "nz"), keys).withColumn("away", F.abs(at)).drop("cx", "cy", "cz", "nx", "ny", "nz")


def robust_fit(points: DataFrame, keys: list[str], trim: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The planes of groups of points (keys, id, x, y, z, w), fitted, trimmed to the points within the `trim` quantile of
    distances (0.5 at least) and fitted again, `rounds` times over; and all points with their distance `away` to the last
    plane. Points without a positive weight or a finite place take no part; a group of under six points is not trimmed
    on, one without a plane is left out. Every round fits all groups at once: keys, n (points in the last fit), cx to cz,
    nx to nz, d, rmse (weighted, over all points)."""
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ("x", "y", "z", "w"))
    rows = stage(points.select(*keys, "id", "x", "y", "z", "w").filter(f"{finite} and w > 0"), "points")
    active = rows
    for _ in range(max(rounds, 1)):
        measured = stage(_away(active, _found(active, keys), keys), "measured")
        cut = measured.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile("away", min(max(trim, 0.5), 1.0)).alias("_cut"))
        near = F.col("away") <= F.greatest("_cut", F.lit(1e-9))
        active = stage(measured.join(cut, keys).filter((F.col("_n") < 6) | near).select(*keys, "id", "x", "y", "z", "w"), "active")
        unstage(measured)
    planes = _found(active, keys)
    each = stage(_away(rows, planes, keys), "away")
    rmse = each.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("away") ** 2) / F.sum("w")).alias("rmse"))
    return planes.select(*keys, "n", "cx", "cy", "cz", "nx", "ny", "nz", "d").join(rmse, keys), each


def depth_plane_hypotheses(pixels: DataFrame, tile: int, least: int, error: float, degrees: float, distance: float, support: int, most: int | None = None) -> DataFrame:
    """(frame, nth, nx, ny, nz, d, points, tiles) of pixels (frame, u, v, x, y, z): broad planes of a frame's depth.
    Tiles of `tile` pixels with at least `least` points are fitted and kept if the median distance is up to `error`;
    planes that agree, rounded to `degrees` of their normal and `distance` of their offset, are one hypothesis, fitted
    to the points of all its tiles and kept with `support` points or more and a median distance up to `distance`.
    Numbered by points, the most first, ties by normal and offset; the first `most` of a frame."""
    at = [F.floor(F.col("u") / tile).alias("tu"), F.floor(F.col("v") / tile).alias("tv")]
    p = stage(pixels.select("frame", *at, *[F.col(c).cast("double").alias(c) for c in "xyz"], F.lit(1.0).alias("w")), "pixels")
    tiles = ["frame", "tu", "tv"]
    fits = _found(p, tiles).filter(F.col("n") >= least)
    good = _away(p, fits, tiles).groupBy(*tiles).agg(F.median("away").alias("m")).filter(F.col("m") <= error).select(*tiles)
    wide, deep = max(2 * math.sin(math.radians(max(degrees, 1e-3)) / 2), 1e-4), max(distance, 1e-5)
    bins = ["ka", "kb", "kc", "kd"]
    named = fits.join(good, tiles).select(*tiles, *[F.rint(F.col(f"n{a}") / wide).cast("long").alias(k) for a, k in zip("xyz", bins, strict=False)], F.rint(F.col("d") / deep).cast("long").alias("kd"))
    member = stage(p.join(named, tiles), "members")
    keys = ["frame", *bins]
    sizes = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("tiles"))
    broad = _found(member, keys).filter(F.col("n") >= support)
    near = _away(member.drop("tu", "tv"), broad, keys).groupBy(*keys).agg(F.median("away").alias("m")).filter(F.col("m") <= distance).select(*keys)
    x = broad.join(near, keys).join(sizes, keys)
    order = Window.partitionBy("frame").orderBy(F.desc("n"), "nx", "ny", "nz", "d")
    x = x.withColumn("nth", F.row_number().over(order) - 1)
    x = x if most is None else x.filter(F.col("nth") < most)
    return x.select("frame", "nth", "nx", "ny", "nz", "d", F.col("n").alias("points"), "tiles")
