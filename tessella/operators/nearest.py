"""The nearest triangle or row of every point, by descent through a tree of boxes, and children bound to new parents by
it. Points in one place are looked up once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import scalar as S
from tessella.functions import vectors as V
from tessella.staging import stage

BITS, LEAF = 20, 8
SLACK = 1 + 1e-9  # of squared distances, for rounding
LO, HI = ["x0", "y0", "z0"], ["x1", "y1", "z1"]
ON = ["xo", "yo", "zo"]


def _up(cell: Column, levels: int) -> Column:
    return F.shiftright(cell, 3 * levels)


class Tree:
    """Rows with boxes in cells of a cube that is halved along each axis from level to level, by their boxes' centres; a
    cell has the box of all that its rows cover, and one place of one of them. The last level is the first one at which
    no cell has more than `leaf` rows, BITS at most."""

    def __init__(self, boxed: DataFrame, leaf: int = LEAF):
        """boxed: any columns, and LO, HI and ON, a place of the row itself, not of its box alone."""
        boxed = stage(boxed, "rows")
        mid = [(F.col(lo) + F.col(hi)) / 2 for lo, hi in zip(LO, HI, strict=True)]
        whole = boxed.agg(*[F.min(m).alias(f"l{k}") for k, m in enumerate(mid)], *[F.max(m).alias(f"h{k}") for k, m in enumerate(mid)]).first()
        wide = max([whole[f"h{k}"] - whole[f"l{k}"] for k in range(3) if whole["l0"] is not None] or [0.0]) or 1.0
        at = [F.least(F.floor((m - F.lit(whole[f"l{k}"])) / wide * (1 << BITS)), F.lit((1 << BITS) - 1)) for k, m in enumerate(mid)]
        placed = stage(boxed.withColumn("cell", V.z_order(at, BITS)), "boxed")
        sizes = stage(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
        low, high = 0, BITS
        while low < high:
            level = (low + high) // 2
            most = sizes.groupBy(_up(F.col("cell"), BITS - level)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
            low, high = (low, level) if most <= leaf else (level + 1, high)
        self.depth = low
        self.rows = placed.withColumn("cell", _up(F.col("cell"), BITS - self.depth))
        self.cells = stage(self._boxes(self.rows, F.col("cell")), "cells")

    @staticmethod
    def _boxes(of: DataFrame, cell: Column) -> DataFrame:
        on = F.first(F.struct(*ON)).alias("on")
        got = of.groupBy(cell.alias("cell")).agg(*[F.min(c).alias(c) for c in LO], *[F.max(c).alias(c) for c in HI], on)
        return got.select("cell", *LO, *HI, "on.*")

    def boxes(self, level: int) -> DataFrame:
        return self.cells if level == self.depth else self._boxes(self.cells, _up(F.col("cell"), self.depth - level))

    def candidates(self, places: DataFrame, radius: float = math.inf) -> DataFrame:
        """The rows that can be nearest to each of places (point, x, y, z) and lie within the radius, beside it.

        A place goes down the tree two levels at a time with the cells that can hold its nearest row. The nearest row is
        no further than the place ON any cell or row that was met, and cells and rows whose box begins beyond the best
        of these are left. A far place so meets few cells, and a cell of many places is an ordinary skewed join. The
        first two steps join at most 64 and 4,096 cells, which are broadcast."""
        p = [F.col(c) for c in "xyz"]
        near = [F.greatest(F.col(lo) - c, c - F.col(hi), F.lit(0.0)) for c, lo, hi in zip(p, LO, HI, strict=True)]
        to = [c - F.col(on) for c, on in zip(p, ON, strict=True)]

        def pruned(met: DataFrame, *keep: str) -> DataFrame:
            keep = ["point", "x", "y", "z", *keep]
            x = met.select(*keep, "best", V.dot(near, near).alias("near"), V.dot(to, to).alias("to")).filter(F.col("near") <= F.col("best") * SLACK)
            x = x.withColumn("best", F.least("best", F.min("to").over(Window.partitionBy("point"))))
            return x.filter(F.col("near") <= F.col("best") * SLACK).select(*keep, "best")

        left, level = places.select("point", *p, F.lit(0).cast("long").alias("cell"), F.lit(radius * radius).alias("best")), 0
        while level < self.depth:
            step = 2 if (self.depth - level) % 2 == 0 else 1
            level += step
            below = self.boxes(level).withColumn("up", _up(F.col("cell"), step))
            below = F.broadcast(below) if level <= 4 else below  # no more than 8**4 rows
            left = pruned(left.withColumnRenamed("cell", "up").join(below, "up"), "cell")
        return pruned(left.join(self.rows, "cell"), *[c for c in self.rows.columns if c != "cell"])


def _finite(points: DataFrame) -> DataFrame:
    return points.filter(" and ".join(f"{c} is not null and abs({c}) < double('Infinity')" for c in "xyz"))


def _places(points: DataFrame) -> DataFrame:
    """The distinct places of points with finite coordinates (x, y, z), numbered."""
    return stage(_finite(points).select("x", "y", "z").distinct().withColumn("point", F.monotonically_increasing_id()), "places")


def _as_point(df: DataFrame, row: str, axes: list[str]) -> DataFrame:
    """(row, x, y, z) of rows with one to three axes; those that are missing are 0."""
    if len(axes) > 3:
        raise ValueError("no more than three axes")
    at = [F.col(c).cast("double") for c in axes] + [F.lit(0.0)] * (3 - len(axes))
    return df.select(F.col(row).alias("row"), *[a.alias(c) for a, c in zip(at, "xyz", strict=True)])


def nearest_rows(left: DataFrame, right: DataFrame, lid: str, rid: str, axes: list[str], radius: float = math.inf, leaf: int = LEAF) -> DataFrame:
    """(l, r, distance): the nearest right row of each left row that has one within the radius; ties to the lowest id.
    Each place is a row of the tree once, with its lowest id, so copies and crowds add rows, not pairs."""
    l, r = _as_point(left, lid, axes), _as_point(right, rid, axes)  # noqa: E741
    places = _places(l)
    there = _finite(r).groupBy("x", "y", "z").agg(F.min("row").alias("r"))
    tree = Tree(there.select("r", *[F.col(c).alias(n) for names in (LO, HI, ON) for c, n in zip("xyz", names, strict=True)]), leaf)
    d2 = sum((F.col(c) - F.col(lo)) ** 2 for c, lo in list(zip("xyz", LO, strict=True))[: len(axes)])
    x = tree.candidates(places, radius).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    best = x.groupBy("point").agg(F.min(F.struct(F.sqrt("d2").alias("distance"), "r")).alias("m"))
    return l.join(places.join(best, "point"), list("xyz")).select(F.col("row").alias("l"), "m.r", "m.distance")


def with_closest(df: DataFrame) -> DataFrame:
    """df (structs p, a, b, c) with the distance of p to the triangle a, b, c, and w, the barycentric weights (wa, wb,
    wc) of its closest place, as vectors.closest_on_triangle has them; column by column, so that no expression holds
    another many times."""
    p, corner = V.of("p"), [V.of(n) for n in "abc"]
    vector = lambda v: F.struct(*[c.alias(k) for c, k in zip(v, "xyz", strict=True)])
    x = df.withColumns({f"_s{k}": vector(V.sub(corner[(k + 1) % 3], corner[k])) for k in range(3)} | {f"_p{k}": vector(V.sub(p, corner[k])) for k in range(3)})
    side, to = [V.of(f"_s{k}") for k in range(3)], [V.of(f"_p{k}") for k in range(3)]
    back = V.scale(side[2], F.lit(-1.0))  # from a to c
    x = x.withColumns({"_up": vector(V.cross(side[0], back)), "_ib": vector(V.cross(to[0], back)), "_ic": vector(V.cross(side[0], to[0]))} | {f"_t{k}": F.greatest(F.least(V.divide(V.dot(to[k], side[k]), V.dot(side[k], side[k])), F.lit(1.0)), F.lit(0.0)) for k in range(3)})
    up = V.of("_up")
    x = x.withColumns({"_size": V.dot(up, up), "_h": V.dot(to[0], up)} | {f"_v{k}": vector(V.sub(to[k], V.scale(side[k], F.col(f"_t{k}")))) for k in range(3)})
    x = x.withColumns({"_wb": V.divide(V.dot(V.of("_ib"), up), F.col("_size")), "_wc": V.divide(V.dot(V.of("_ic"), up), F.col("_size"))} | {f"_d{k}": V.dot(V.of(f"_v{k}"), V.of(f"_v{k}")) for k in range(3)})
    x = x.withColumn("_in", (F.col("_size") > 0) & (F.col("_wb") >= 0) & (F.col("_wc") >= 0) & (F.col("_wb") + F.col("_wc") <= 1)).withColumn("_least", F.least("_d0", "_d1", "_d2"))
    x = x.withColumn("_k", F.when(F.col("_in"), -1).when(F.col("_d0") == F.col("_least"), 0).when(F.col("_d1") == F.col("_least"), 1).otherwise(2))
    k, t = F.col("_k"), [F.col(f"_t{k}") for k in range(3)]
    weights = [
        F.when(k == -1, 1 - F.col("_wb") - F.col("_wc")).when(k == 0, 1 - t[0]).when(k == 2, t[2]).otherwise(0.0),
        F.when(k == -1, F.col("_wb")).when(k == 0, t[0]).when(k == 1, 1 - t[1]).otherwise(0.0),
        F.when(k == -1, F.col("_wc")).when(k == 1, t[1]).when(k == 2, 1 - t[2]).otherwise(0.0),
    ]
    distance = F.when(k == -1, F.abs("_h") / F.sqrt("_size")).otherwise(F.sqrt("_least"))
    return x.select(*df.columns, distance.alias("distance"), F.struct(*[w.alias(f"w{n}") for w, n in zip(weights, "abc", strict=True)]).alias("w"))


def nearest_triangles(points: DataFrame, corners: DataFrame, point: str = "point", leaf: int = LEAF) -> DataFrame:
    """(point, face, distance, wa, wb, wc): the triangle of corners (face, and structs a, b, c with x, y, z) that is
    nearest to each of points (point, x, y, z), of equals the lowest, and the barycentric weights of its closest place.
    Points without a coordinate have none."""
    ends = [F.least(*[F.col(f"{n}.{k}") for n in "abc"]).alias(v) for k, v in zip("xyz", LO, strict=True)]
    ends += [F.greatest(*[F.col(f"{n}.{k}") for n in "abc"]).alias(v) for k, v in zip("xyz", HI, strict=True)]
    ends += [F.col(f"a.{k}").alias(v) for k, v in zip("xyz", ON, strict=True)]
    tree = Tree(corners.select("face", "a", "b", "c", *ends), leaf)
    p = _as_point(points, point, list("xyz"))
    places = _places(p)
    x = with_closest(tree.candidates(places).select("point", F.struct("x", "y", "z").alias("p"), "face", "a", "b", "c"))
    best = places.join(x.groupBy("point").agg(F.min(F.struct("distance", "face", "w")).alias("m")), "point")
    return p.join(best, list("xyz")).select(F.col("row").alias(point), "m.face", "m.distance", "m.w.wa", "m.w.wb", "m.w.wc")


def reparented(children: DataFrame, corners: DataFrame, low: float, high: float, child: str = "child") -> DataFrame:
    """Children (child, x, y, z, sx, sy, ux, uy, uz: place, two scales, main axis) bound to the triangles of a new mesh
    that are nearest to them: child, face, distance, uv_sum and u_ratio (logits of where the closest place lies),
    scale_x and scale_y (logits of the scales over the triangle's inner radius, between low and high), scale_clamped,
    turn_x and turn_y (the main axis in the triangle's plane; its first side where it stands upright)."""
    near = nearest_triangles(children, corners, child).withColumnRenamed("distance", "away")
    x = children.select(child, "sx", "sy", "ux", "uy", "uz").join(near, child).join(corners.select("face", "a", "b", "c"), "face")
    ab, ac, bc = (V.sub(V.of(v), V.of(u)) for u, v in ("ab", "ac", "bc"))
    x = x.withColumns({f"s{k}": c for k, c in enumerate(ab)}).withColumns({f"n{k}": c for k, c in enumerate(V.cross(ab, ac))})
    side, up = [F.col(f"s{k}") for k in range(3)], [F.col(f"n{k}") for k in range(3)]
    x = x.withColumn("radius", V.divide(V.norm(up), V.norm(ab) + V.norm(ac) + V.norm(bc)))
    one = lambda v: V.scale(v, 1 / F.greatest(V.norm(v), F.lit(1e-12)))
    x = x.withColumns({f"s{k}": c for k, c in enumerate(one(side))} | {f"n{k}": c for k, c in enumerate(one(up))})
    x = x.withColumns({f"t{k}": c for k, c in enumerate(V.cross(up, side))})
    axis = one([F.col(f"u{k}") for k in "xyz"])
    x = x.withColumn("along", V.dot(axis, side)).withColumn("across", V.dot(axis, [F.col(f"t{k}") for k in range(3)]))
    flat = F.sqrt(F.col("along") * F.col("along") + F.col("across") * F.col("across"))
    both = F.least(F.greatest(F.col("wb") + F.col("wc"), F.lit(0.0)), F.lit(1.0))
    ratio = F.when(both > 1e-6, F.least(F.greatest(F.col("wb") / F.greatest(both, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)
    part = [(F.col(s) / F.greatest("radius", F.lit(1e-6)) - low) / max(high - low, 1e-6) for s in ("sx", "sy")]
    outside = [(q < 1e-4) | (q > 1 - 1e-4) for q in part]
    return x.select(
        child, "face", F.col("away").alias("distance"), S.logit_clamped(both, 1e-4).alias("uv_sum"), S.logit_clamped(ratio, 1e-4).alias("u_ratio"),
        S.logit_clamped(part[0], 1e-4).alias("scale_x"), S.logit_clamped(part[1], 1e-4).alias("scale_y"), (outside[0] | outside[1]).alias("scale_clamped"),
        F.when(flat > 1e-5, F.col("along") / flat).otherwise(1.0).alias("turn_x"), F.when(flat > 1e-5, F.col("across") / flat).otherwise(0.0).alias("turn_y"),
    )
