"""Splats and triangles to pixels: projection, hits of pixels, depth buffers, and operators on tall pixel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vectors as V

from .windows import composite, composite_batches

SIX = ("xx", "xy", "xz", "yy", "yz", "zz")


def to_camera(splats: DataFrame, cameras: DataFrame) -> DataFrame:
    """Every splat (x, y, z, and its covariance's upper triangle) before every camera (camera, r00 to r22, t0 to t2), in
    that camera's space. The result has a row for each pair; the cameras are the side of a checked size: Spark
    broadcasts them below spark.sql.autoBroadcastJoinThreshold."""
    s = splats.crossJoin(cameras)
    r = [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]
    p = [F.col(c) for c in "xyz"]
    m = {n: F.col(n) for n in SIX}
    full = [[m["xx"], m["xy"], m["xz"]], [m["xy"], m["yy"], m["yz"]], [m["xz"], m["yz"], m["zz"]]]
    half = [[V.dot(r[i], [full[k][j] for k in range(3)]) for j in range(3)] for i in range(3)]
    moved = [(V.dot(r[i], p) + F.col(f"t{i}")).alias(c) for i, c in enumerate("xyz")]
    turned = [V.dot(half[i], r[j]).alias(SIX[k]) for k, (i, j) in enumerate((i, j) for i in range(3) for j in range(i, 3))]
    rest = [c for c in splats.columns if c not in (*"xyz", *SIX)] + [c for c in cameras.columns if c[0] not in "rt" or len(c) > 3]
    return s.select(*rest, *moved, *turned)


def project(seen: DataFrame, width: int, height: int, blur: float = 0.3, near: float = 0.01, far: float = 1e10) -> DataFrame:
    """to_camera() (with fx, fy, cx, cy) as ellipses on the image: u, v, depth, conic (ka, kb, kc), shrink (what the blur
    takes off an opacity), radius: 3 standard deviations of the longer axis, rounded up. Only those that show."""
    fx, fy, cx, cy, x, y, z = (F.col(c) for c in ("fx", "fy", "cx", "cy", "x", "y", "z"))
    side = lambda size, f: 0.3 * (0.5 * size / f)
    tx = z * F.greatest(F.least(x / z, (width - cx) / fx + side(width, fx)), -(cx / fx + side(width, fx)))
    ty = z * F.greatest(F.least(y / z, (height - cy) / fy + side(height, fy)), -(cy / fy + side(height, fy)))
    out = seen.filter((z > near) & (z < far)).withColumn("j0", fx / z).withColumn("j2", -fx * tx / (z * z)).withColumn("k1", fy / z).withColumn("k2", -fy * ty / (z * z))
    j0, j2, k1, k2 = (F.col(c) for c in ("j0", "j2", "k1", "k2"))
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in SIX)
    out = out.withColumn("_a", j0 * j0 * xx + 2 * j0 * j2 * xz + j2 * j2 * zz).withColumn("_b", j0 * k1 * xy + j0 * k2 * xz + j2 * k1 * yz + j2 * k2 * zz).withColumn("_c", k1 * k1 * yy + 2 * k1 * k2 * yz + k2 * k2 * zz)
    a, b, c = F.col("_a") + blur, F.col("_b"), F.col("_c") + blur
    out = out.withColumn("det", F.greatest(a * c - b * b, F.lit(1e-10)))
    det, mid = F.col("det"), (a + c) / 2
    out = out.withColumn("radius", F.ceil(3 * F.sqrt(mid + F.sqrt(F.greatest(mid * mid - det, F.lit(0.01))))).cast("int"))
    out = out.withColumn("u", fx * x / z + cx).withColumn("v", fy * y / z + cy).withColumn("ka", c / det).withColumn("kb", -b / det).withColumn("kc", a / det)
    out = out.withColumn("shrink", F.sqrt(F.greatest((F.col("_a") * F.col("_c") - b * b) / det, F.lit(0.0)))).withColumnRenamed("z", "depth")
    r = F.col("radius")
    shows = (F.col("u") + r > 0) & (F.col("u") - r < width) & (F.col("v") + r > 0) & (F.col("v") - r < height)
    # the row number keeps the optimiser from pushing the test down into all that it is computed from
    return out.withColumn("_fence", F.monotonically_increasing_id()).filter(shows & (F.col("_fence") >= 0)).drop("_fence", "_a", "_b", "_c", "j0", "j2", "k1", "k2", "det", "x", "y", *SIX, "fx", "fy", "cx", "cy")


def pixel_hits(shown: DataFrame, width: int, height: int, opacity: str) -> DataFrame:
    """project() by pixel (px, py) of the square around each splat that it covers with an alpha of 1/255 or more. Splats
    are spread over all tasks first, as each becomes as many rows as it has pixels."""
    shown = shown.repartition(*[c for c in shown.columns if c in ("depth", "u", "v")])
    lo = lambda c: F.greatest(F.floor(F.col(c) - F.col("radius")), F.lit(0))
    hi = lambda c, n: F.least(F.ceil(F.col(c) + F.col("radius")), F.lit(n)) - 1
    x = shown.withColumn("_x0", lo("u")).withColumn("_x1", hi("u", width)).withColumn("_y0", lo("v")).withColumn("_y1", hi("v", height)).filter("_x0 <= _x1 and _y0 <= _y1")
    x = x.withColumn("px", F.explode(F.sequence("_x0", "_x1"))).withColumn("py", F.explode(F.sequence("_y0", "_y1"))).drop("_x0", "_x1", "_y0", "_y1")
    du, dv = F.col("px") + 0.5 - F.col("u"), F.col("py") + 0.5 - F.col("v")
    power = 0.5 * (F.col("ka") * du * du + F.col("kc") * dv * dv) + F.col("kb") * du * dv
    return x.withColumn("alpha", F.least(F.col(opacity) * F.exp(-power), F.lit(0.999))).filter((power >= 0) & (F.col("alpha") >= 1 / 255))


def render(shown: DataFrame, width: int, height: int, keys: list[str], row: str, opacity: str, color: str) -> DataFrame:
    """keys, px, py, color, opacity, used: hits composited from front to back."""
    return composite(pixel_hits(shown, width, height, opacity), [*keys, "px", "py"], ["depth", row], "alpha", color)


def render_batches(shown: DataFrame, width: int, height: int, keys: list[str], row: str, opacity: str, colors: list[str], slab: float) -> DataFrame:
    """render() of several colours, by slabs of depth: keys, px, py, the colours, opacity, used."""
    hits = pixel_hits(shown, width, height, opacity)
    return composite_batches(hits, [*keys, "px", "py"], F.floor(F.col("depth") / slab), ["depth", row], "alpha", colors)


def raster_triangles(corners: DataFrame, face: str, width: int, height: int, keys: list[str] = ()) -> DataFrame:
    """(keys, px, py, face, depth): the nearest triangle on each pixel's centre, from corners a, b, c (x and y in pixels, z
    the depth); depth is interpolated by its inverse; ties go to the lowest face."""
    a, b, c = V.of("a"), V.of("b"), V.of("c")
    lo = lambda k: F.greatest(F.floor(F.least(a[k], b[k], c[k])), F.lit(0))
    hi = lambda k, n: F.least(F.ceil(F.greatest(a[k], b[k], c[k])) + 1, F.lit(n)) - 1
    whole = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
    x = corners.withColumn("_d", whole).filter(F.abs("_d") >= 1e-12).withColumn("_x0", lo(0)).withColumn("_x1", hi(0, width)).withColumn("_y0", lo(1)).withColumn("_y1", hi(1, height)).filter("_x0 <= _x1 and _y0 <= _y1")
    x = x.withColumn("px", F.explode(F.sequence("_x0", "_x1"))).withColumn("py", F.explode(F.sequence("_y0", "_y1")))
    px, py = F.col("px") + 0.5, F.col("py") + 0.5
    x = x.withColumn("_u", ((b[1] - c[1]) * (px - c[0]) + (c[0] - b[0]) * (py - c[1])) / F.col("_d")).withColumn("_v", ((c[1] - a[1]) * (px - c[0]) + (a[0] - c[0]) * (py - c[1])) / F.col("_d"))
    u, v = F.col("_u"), F.col("_v")
    x = x.filter((u >= -1e-5) & (v >= -1e-5) & (1 - u - v >= -1e-5)).withColumn("depth", 1 / F.greatest(u / a[2] + v / b[2] + (1 - u - v) / c[2], F.lit(1e-12)))
    best = x.groupBy(*keys, "px", "py").agg(F.min(F.struct("depth", face)).alias("m"))
    return best.select(*keys, "px", "py", F.col(f"m.{face}").alias(face), F.col("m.depth").alias("depth"))


def candidates(corners: DataFrame, near: float, width: int, height: int) -> DataFrame:
    """Triangles in front of the camera whose box meets the image."""
    a, b, c = V.of("a"), V.of("b"), V.of("c")
    real = F.lit(True)
    for x in (*a, *b, *c):
        real = real & ~F.isnan(x) & (F.abs(x) != float("inf"))
    meets = (F.greatest(a[0], b[0], c[0]) >= 0) & (F.least(a[0], b[0], c[0]) < width) & (F.greatest(a[1], b[1], c[1]) >= 0) & (F.least(a[1], b[1], c[1]) < height)
    return corners.filter(real & (F.least(a[2], b[2], c[2]) > near) & meets)


def depth_normals(px: DataFrame, keys: list[str], fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """(keys, u, v, nx, ny, nz) of a depth image: the cross product of the steps between the points of the left and right,
    and of the upper and lower neighbour; pixels without all four have none. Neighbours send their points, so that a
    frame needs no window of its own."""
    d = F.col("depth")
    p = F.named_struct(F.lit("x"), (F.col("u") - cx) / fx * d, F.lit("y"), (F.col("v") - cy) / fy * d, F.lit("z"), d)
    steps = F.array(*[F.struct(F.lit(a).alias("du"), F.lit(b).alias("dv"), F.lit(n).alias("n")) for a, b, n in ((0, 0, "o"), (1, 0, "l"), (-1, 0, "r"), (0, 1, "t"), (0, -1, "b"))])
    sent = px.select(*keys, "u", "v", p.alias("p"), F.explode(steps).alias("s")).select(*keys, (F.col("u") + F.col("s.du")).alias("u"), (F.col("v") + F.col("s.dv")).alias("v"), "p", F.col("s.n").alias("n"))
    x = sent.groupBy(*keys, "u", "v").agg(*[F.max(F.when(F.col("n") == n, F.col("p"))).alias(n) for n in "olrtb"]).filter(" and ".join(f"{n} is not null" for n in "olrtb"))
    n = V.cross(V.sub(V.of("r"), V.of("l")), V.sub(V.of("b"), V.of("t")))
    return x.select(*keys, "u", "v", *[(c / F.greatest(V.norm(n), F.lit(1e-12))).alias(f"n{k}") for c, k in zip(n, "xyz", strict=True)])


def id_edges(px: DataFrame, keys: list[str], x: str, thickness: int = 1) -> DataFrame:
    """(keys, u, v): pixels beside one of another id, or at a silhouette (an id below 0 is background), widened to squares of
    the thickness; only pixels of px."""
    out = []
    for order, other in (("u", "v"), ("v", "u")):
        w = Window.partitionBy(*keys, other).orderBy(order)
        for step in (1, -1):
            at, near = F.lag(order, step).over(w), F.lag(x, step).over(w)
            out.append((F.abs(at - F.col(order)) == 1) & ((F.col(x) >= 0) != (near >= 0)) | (F.abs(at - F.col(order)) == 1) & (F.col(x) >= 0) & (near >= 0) & (near != F.col(x)))
    hit = px.select(*keys, "u", "v", F.coalesce(out[0], F.lit(False)).alias("a"), F.coalesce(out[1], F.lit(False)).alias("b"), F.coalesce(out[2], F.lit(False)).alias("c"), F.coalesce(out[3], F.lit(False)).alias("d")).filter("a or b or c or d").select(*keys, "u", "v")
    if thickness > 1:
        lo, hi = -(thickness // 2), (thickness - 1) // 2
        hit = hit.withColumn("u", F.explode(F.sequence(F.col("u") + lo, F.col("u") + hi))).withColumn("v", F.explode(F.sequence(F.col("v") + lo, F.col("v") + hi))).distinct()
        hit = hit.join(px.select(*keys, "u", "v"), [*keys, "u", "v"], "left_semi")
    return hit


def structure_confidence(j11: Column, j12: Column, j22: Column, eps: float = 1e-8) -> Column:
    """How far one gradient direction stands out of a 2 x 2 structure tensor, from 0 to 1."""
    return F.sqrt(F.greatest((j11 - j22) * (j11 - j22) + 4 * j12 * j12, F.lit(0.0))) / F.greatest(j11 + j22, F.lit(eps))


def resize_intrinsics(f: Column, c: Column, size: Column, most: int) -> tuple[Column, Column, Column]:
    """Focal length, centre and size of an image that is scaled down to at most `most` pixels."""
    k = F.least(F.lit(1.0), most / size)
    return f * k, c * k, F.greatest(F.rint(size * k), F.lit(1.0)).cast("int")
