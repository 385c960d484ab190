"""Topology, range and nearest-neighbour joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nearest import nearest_rows


def edges(faces: DataFrame, corners: list[str], face: str) -> DataFrame:
    """Undirected edges of polygons with their faces in order: one shuffle on the edge, instead of a self join."""
    n = len(corners)
    half = F.array(*[F.struct(F.least(corners[k], corners[(k + 1) % n]).alias("a"), F.greatest(corners[k], corners[(k + 1) % n]).alias("b")) for k in range(n)])
    h = faces.select(F.col(face).alias("face"), F.explode(half).alias("e")).select("e.a", "e.b", "face").filter("a <> b")
    return h.groupBy("a", "b").agg(F.min("face").alias("face_a"), F.when(F.count(F.lit(1)) > 1, F.max("face")).alias("face_b"), F.count(F.lit(1)).alias("n_faces"))


def gather(edge: DataFrame, values: DataFrame, key: str, x: str) -> DataFrame:
    """min, max and mean of a value over an edge's one or two faces."""
    a = values.select(F.col(key).alias("face_a"), F.col(x).alias("xa"))
    b = values.select(F.col(key).alias("face_b"), F.col(x).alias("xb"))
    other = F.coalesce("xb", "xa")
    return edge.join(a, "face_a").join(b, "face_b", "left").select("a", "b", F.least("xa", other).alias("low"), F.greatest("xa", other).alias("high"), ((F.col("xa") + other) / 2).alias("mean"))


def tiles(df: DataFrame, row: str, x: str, y: str, radius: str, size: int, wide: int, high: int) -> DataFrame:
    """(tile_x, tile_y, row) of every tile of a grid that a square of the radius touches."""
    lo = lambda c: F.greatest(F.floor((F.col(c) - F.col(radius)) / size), F.lit(0))
    hi = lambda c, n: F.least(F.ceil((F.col(c) + F.col(radius)) / size), F.lit(n)) - 1
    t = df.filter(F.col(radius) > 0).select(row, lo(x).alias("x0"), hi(x, wide).alias("x1"), lo(y).alias("y0"), hi(y, high).alias("y1")).filter("x0 <= x1 and y0 <= y1")
    t = t.withColumn("tile_x", F.explode(F.sequence("x0", "x1"))).withColumn("tile_y", F.explode(F.sequence("y0", "y1")))
    return t.select("tile_x", "tile_y", row)


def within(left: DataFrame, right: DataFrame, lid: str, rid: str, axes: list[str], radius: float) -> DataFrame:
    """Pairs not further apart than the radius, by cells of that width: each left row looks in the 3**d cells around
    it, so the join is an equi-join and only neighbours meet."""
    cell = lambda c: F.floor(F.col(c) / radius)
    l = left.select(F.col(lid).alias("l"), *[F.col(c).alias("l_" + c) for c in axes], *[F.explode(F.sequence(cell(c) - 1, cell(c) + 1)).alias("c0") for c in axes[:1]])  # noqa: E741
    for k, c in enumerate(axes[1:], 1):
        l = l.withColumn(f"c{k}", F.explode(F.sequence(F.floor(F.col("l_" + c) / radius) - 1, F.floor(F.col("l_" + c) / radius) + 1)))  # noqa: E741
    r = right.select(F.col(rid).alias("r"), *[F.col(c).alias("r_" + c) for c in axes], *[cell(c).alias(f"c{k}") for k, c in enumerate(axes)])
    d2 = sum((F.col("l_" + c) - F.col("r_" + c)) ** 2 for c in axes)
    return l.join(r, [f"c{k}" for k in range(len(axes))]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).select("l", "r", F.sqrt("d2").alias("distance"))


def nearest_within(left: DataFrame, right: DataFrame, lid: str, rid: str, axes: list[str], radius: float) -> DataFrame:
    """The nearest right row of each left row that has one within the radius; ties to the lowest id. By a tree of
    boxes, as the pairs within a radius grow with the square of the rows that crowd there."""
    return nearest_rows(left, right, lid, rid, axes, radius)


def covered_by_manifest(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left that have no partner: an empty result asserts that a manifest join is whole."""
    return left.join(right, on, "left_anti")
