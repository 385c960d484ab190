"""Tall pixel tables (frame, u, v, value): central differences and smoothed structure tensors, by joins on pixels that
neighbours send, so that no frame or row of it must fit one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sent(px: DataFrame, keys: list[str], sums: dict[str, str], steps: list[tuple[int, int, str, float]]) -> DataFrame:
    """Sums over what each pixel sends to the pixels at the steps (du, dv, name, factor); only pixels of px are kept."""
    sent = F.explode(F.array(*[F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv"), F.lit(name).alias("name"), F.lit(float(f)).alias("f")) for du, dv, name, f in steps]))
    x = px.withColumn("_s", sent)
    x = x.select(*keys, (F.col("u") + F.col("_s.du")).alias("u"), (F.col("v") + F.col("_s.dv")).alias("v"), F.col("_s.name").alias("_n"), F.col("_s.f").alias("_f"), *set(sums.values()), ((F.col("_s.du") == 0) & (F.col("_s.dv") == 0)).alias("_own"))
    out = x.groupBy(*keys, "u", "v").agg(F.max("_own").alias("_in"), *[F.sum(F.when(F.col("_n") == n.split(":")[0], F.col(c) * F.col("_f"))).alias(n.split(":")[1]) for n, c in sums.items()])
    return out.filter("_in").drop("_in")


def gradients(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, u, v, gu, gv: half the difference of the two neighbours; a missing neighbour counts as 0."""
    steps = [(0, 0, "x", 0.0), (0, 0, "y", 0.0), (1, 0, "x", -0.5), (-1, 0, "x", 0.5), (0, 1, "y", -0.5), (0, -1, "y", 0.5)]
    return _sent(px, keys, {"x:gu": value, "y:gv": value}, steps)


def structure_tensor(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, u, v, j11, j12, j22: products of the gradients summed over the 3 x 3 pixels around each."""
    g = gradients(px, keys, value).withColumn("_a", F.col("gu") * F.col("gu")).withColumn("_b", F.col("gu") * F.col("gv")).withColumn("_c", F.col("gv") * F.col("gv"))
    steps = [(du, dv, "j", 1.0) for du in (-1, 0, 1) for dv in (-1, 0, 1)]
    return _sent(g, keys, {"j:j11": "_a", "j:j12": "_b", "j:j22": "_c"}, steps)


def nearest_set(wanted: DataFrame, is_set: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """wanted (keys, u, v, anything else) with near_u, near_v and distance of the nearest pixel of is_set (keys, u, v) that
    is at most `reach` away; ties go to the lower v, then u; rows without one are left out, equal rows
    are one. A row looks along the
    2 * reach + 1 lines of pixels around it, in each at the set pixels next to its place on both sides only, which a
    window over the line's pixels gives; so no pair of pixels is met that isn't next to the other on its line."""
    names = wanted.columns
    place = F.struct(*names).alias("_row")
    asks = wanted.select(*keys, F.explode(F.sequence(F.col("v") - reach, F.col("v") + reach)).alias("_line"), F.col("u").alias("_at"), place)
    row_type = next(f.dataType for f in asks.schema.fields if f.name == "_row")
    line = asks.unionByName(is_set.select(*keys, F.col("v").alias("_line"), F.col("u").alias("_at"), F.lit(None).cast(row_type).alias("_row")).distinct())
    there = F.when(F.col("_row").isNull(), F.col("_at"))
    w = Window.partitionBy(*keys, "_line").orderBy("_at")
    # rows at one place see each other: a range frame
    left = F.max(there).over(w.rangeBetween(Window.unboundedPreceding, 0))
    right = F.min(there).over(w.rangeBetween(0, Window.unboundedFollowing))
    x = line.select("_row", "_line", "_at", left.alias("_left"), right.alias("_right")).filter("_row is not null")
    side = F.when(F.col("_right").isNull() | (F.col("_at") - F.col("_left") <= F.col("_right") - F.col("_at")), F.col("_left")).otherwise(F.col("_right"))
    x = x.withColumn("_u", side).filter("_u is not null").withColumn("_d2", (F.col("_u") - F.col("_at")) ** 2 + (F.col("_line") - F.col("_row.v")) ** 2).filter(F.col("_d2") <= reach * reach)
    best = x.groupBy("_row").agg(F.min(F.struct("_d2", "_line", "_u")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return best.select("_row.*", F.col("_m._u").alias("near_u"), F.col("_m._line").alias("near_v"), F.sqrt("_m._d2").alias("distance"))


def offset_evidence(pixels: DataFrame, high: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """(face, n, gradient, target, steepest) of pixels of steep gradient (keys, u, v, gradient, target) given to the face
    of the nearest pixel that shows one (keys, u, v, face) within reach: how many, their gradients' and targets' sums
    with weights exp(-distance**2 / (2 * reach**2)), and the largest gradient."""
    shown = pixels.filter("face is not null and face >= 0").select(*keys, "u", "v", "face")
    near = nearest_set(high, shown, keys, reach)
    x = near.join(shown.select(*keys, F.col("u").alias("near_u"), F.col("v").alias("near_v"), "face"), [*keys, "near_u", "near_v"])
    weight = F.exp(-F.col("distance") * F.col("distance") / (2 * max(reach, 1e-6) ** 2))
    return x.groupBy("face").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gradient") * weight).alias("gradient"), F.sum(F.col("target") * weight).alias("target"), F.max("gradient").alias("steepest"))
