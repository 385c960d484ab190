"""Coresets: a few points of each group that lie far from each other and not far from its middle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.staging import reread, stage


def _corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull: those of equal points the first, none on a side."""
    order = np.lexsort((np.arange(len(x)), y, x))
    order = order[np.concatenate(([True], (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)))] if len(order) else order
    if len(order) < 3:
        return order

    def half(of: np.ndarray) -> list[int]:
        out: list[int] = []
        for k in of:
            while len(out) > 1:
                i, j = out[-2:]
                if (x[j] - x[i]) * (y[k] - y[i]) - (y[j] - y[i]) * (x[k] - x[i]) > 0:
                    break
                out.pop()
            out.append(k)
        return out

    return np.array(half(order)[:-1] + half(order[::-1])[:-1])


def hull(points: DataFrame, key: str) -> DataFrame:
    """(key, id, x, y) of the corners of each group's convex hull; points (key, id, x, y). A batch of rows keeps the
    corners of its own points of each group, which hold the group's, so that what is gathered for a group is as many
    corners as its batches have, not its points."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.sort_values("id").groupby(key, dropna=False):
                yield g.iloc[_corners(g["x"].to_numpy(), g["y"].to_numpy())]

    def all_(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        return g.iloc[_corners(g["x"].to_numpy(), g["y"].to_numpy())]

    rows = points.select(F.col(key).cast("long").alias(key), F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.mapInPandas(own, rows.schema).groupBy(key).applyInPandas(all_, rows.schema)


def greedy_coreset(points: DataFrame, key: str, count: int, alpha: float) -> DataFrame:
    """(key, nth, id, x, y): up to `count` points of each group of points (key, id, x, y), by a scan that begins with the
    one nearest to the mean and goes on with the one whose distance to the nearest pick, less alpha times that to the
    mean, is largest; ties go to the lower id. Groups of up to `count` points are taken whole, in the order of ids; in
    others the hull's corners take no part, if `count` points are left without them.

    A round is an aggregation that sends one row for each group and task, and a broadcast-free join of the picks so far,
    `count` at most, with the points."""
    p = stage(points.select(key, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    size = p.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    corner = stage(hull(p, key).select(key, "id"), "hull")
    dropped = corner.groupBy(key).agg(F.count(F.lit(1)).alias("n_hull"))
    kind = size.join(dropped, key, "left").withColumn("inner", (F.col("n") > 3) & (F.col("n") - F.coalesce("n_hull", F.lit(0)) >= count))
    x = p.join(kind.select(key, "n", "inner"), key).join(corner.withColumn("is_corner", F.lit(True)), [key, "id"], "left")
    many = x.filter(F.col("n") > count).filter(~F.col("inner") | F.col("is_corner").isNull()).select(key, "id", "x", "y")
    mean = many.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    away = lambda a, b: F.sqrt((F.col("x") - a) ** 2 + (F.col("y") - b) ** 2)
    many = stage(many.join(mean, key).withColumn("away", away(F.col("mx"), F.col("my"))).select(key, "id", "x", "y", "away"), "coreset")
    pick = lambda df, score: df.groupBy(key).agg(F.max(F.struct(score.alias("score"), (-F.col("id")).alias("i"), "id", "x", "y")).alias("m")).select(key, "m.id", "m.x", "m.y")
    picks = [stage(pick(many, -F.col("away")).withColumn("nth", F.lit(0)), "picks")]
    for k in range(1, count):
        so_far = reread(picks).groupBy(key).agg(F.collect_list(F.struct("id", "x", "y")).alias("picked"))  # k at most
        y = many.join(so_far, key).filter(~F.exists("picked", lambda q: q["id"] == F.col("id")))
        near = F.sqrt(F.array_min(F.transform("picked", lambda q: (F.col("x") - q["x"]) ** 2 + (F.col("y") - q["y"]) ** 2)))
        picks.append(stage(pick(y, near - alpha * F.col("away")).withColumn("nth", F.lit(k)), "picks"))
    few = p.join(size.filter(F.col("n") <= count), key)
    nth = few.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("all")).select(key, F.posexplode("all").alias("nth", "q")).select(key, "nth", "q.id", "q.x", "q.y")
    return reread(picks).select(key, "nth", "id", "x", "y").union(nth) if count > 0 else nth.filter("false")
