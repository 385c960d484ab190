"""Folds in order and measures over pairs: thinning, smoothing, tracks, affinities, evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import greedy_matching
from .nearest import nearest_rows
from .windows import quantiles


def thin(df: DataFrame, keys: list[str], x: str, gap: int) -> DataFrame:
    """Values of each key at least `gap` after the last that was kept; the first and last always stay. A fold over a
    key's sorted values, which have to fit a row; more than that a fold in order can't be."""
    v = df.groupBy(*keys).agg(F.array_sort(F.collect_set(x)).alias("_v"))
    first, inner = F.col("_v")[0], F.slice("_v", F.lit(2), F.greatest(F.size("_v") - 2, F.lit(0)))
    kept = F.aggregate(inner, F.array(first), lambda a, y: F.when(y - F.element_at(a, -1) >= gap, F.concat(a, F.array(y))).otherwise(a))
    last = F.element_at("_v", -1)
    every = F.when(F.element_at(kept, -1) == last, kept).otherwise(F.concat(kept, F.array(last)))
    return v.select(*keys, F.explode(F.when(F.size("_v") <= 2, F.col("_v")).otherwise(every)).alias(x))


def hann(df: DataFrame, x: str, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Centred mean of n values (odd), weighted by a raised cosine; what lies beyond the ends is left out of the mean."""
    w, half = Window.partitionBy(*keys).orderBy(*order), n // 2
    weight = [0.5 - 0.5 * math.cos(2 * math.pi * (k + 1) / (n + 1)) for k in range(n)]
    at = [F.lag(x, half - k).over(w) for k in range(n)]
    total = sum((F.coalesce(a * f, F.lit(0.0)) for a, f in zip(at, weight, strict=True)), F.lit(0.0))
    mass = sum((F.when(a.isNotNull(), f).otherwise(0.0) for a, f in zip(at, weight, strict=True)), F.lit(0.0))
    return df.withColumn("smooth", total / mass)


def assign_tracks(overlap: DataFrame, now: DataFrame, least: float, next_id: int) -> DataFrame:
    """(now, track, iou) of a frame's masks, from overlap (was, now, iou) with the frame before: pairs in the order of
    falling overlap, each mask once, from `least` on; other masks get new ids from next_id on, in the order of theirs."""
    pairs = overlap.filter(F.col("iou") >= least).select(F.col("was").alias("a"), (-F.col("now") - 1).alias("b"), F.negative("iou").alias("rank"))
    taken = greedy_matching(pairs).select((-F.col("b") - 1).alias("now"), F.col("a").alias("track"), F.negative("rank").alias("iou"))
    new = now.select("now").join(taken, "now", "left_anti").withColumn("track", F.row_number().over(Window.orderBy("now")) - 1 + next_id)  # a frame's masks
    return taken.unionByName(new.withColumn("iou", F.lit(None).cast("double")))


def affinity(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """(a, b, confidence, score) of edges from seen (point, frame, label): frames that see both ends, and the share of them in
    which both have one label."""
    at = lambda c: seen.select(F.col("point").alias(c), "frame", F.col("label").alias(f"_{c}"))
    both = edges.select("a", "b").join(at("a"), "a").join(at("b"), ["b", "frame"])
    got = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("confidence"), (F.count(F.when(F.col("_a") == F.col("_b"), 1)) / F.count(F.lit(1))).alias("score"))
    return edges.select("a", "b").join(got, ["a", "b"], "left").select("a", "b", F.coalesce("confidence", F.lit(0)).alias("confidence"), F.coalesce("score", F.lit(0.0)).alias("score"))


def nearest_any(left: DataFrame, right: DataFrame, lid: str, rid: str, axes: list[str]) -> DataFrame:
    """The nearest right row of every left row, however far; ties to the lowest id. An empty right gives none."""
    return nearest_rows(left, right, lid, rid, axes)


def agreement(there: DataFrame, back: DataFrame, limit: float) -> DataFrame:
    """One row from the distances of both directions: accuracy, completeness, chamfer, precision, recall and fscore (0 where
    neither is above 0)."""
    mean = lambda d, a, b: d.agg(F.avg("distance").alias(a), F.avg((F.col("distance") <= limit).cast("double")).alias(b))
    x = mean(there, "accuracy", "precision").join(F.broadcast(mean(back, "completeness", "recall")))  # one row each
    total = F.col("precision") + F.col("recall")
    return x.withColumn("chamfer", (F.col("accuracy") + F.col("completeness")) / 2).withColumn("fscore", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def scene_means(df: DataFrame, scene: str, columns: list[str]) -> DataFrame:
    """(metric, mean, scenes): each column's mean over scenes of its mean in the scene."""
    each = df.groupBy(scene).agg(*[F.avg(c).alias(c) for c in columns])
    return each.unpivot([scene], columns, "metric", "value").groupBy("metric").agg(F.avg("value").alias("mean"), F.count("value").alias("scenes"))


def within_percentiles(df: DataFrame, keys: list[str], x: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies between two quantiles of their group, joined back by group."""
    b = quantiles(df, x, keys, {"_lo": low, "_hi": high})
    return df.join(b, keys).filter((F.col(x) >= F.col("_lo")) & (F.col(x) <= F.col("_hi"))).drop("_lo", "_hi")


def hold_out(df: DataFrame, row: str, every: int) -> DataFrame:
    """df with split: 'test' for every n-th row by a dense id, else 'train'."""
    return df.withColumn("split", F.when(F.col(row) % every == 0, "test").otherwise("train"))


def target_count(now: Column, event: Column, ratios: list[float], least: int, most: int) -> Column:
    """How many faces an event leaves: the share of its place in the schedule (the last one from then on), bounded."""
    ratio = F.element_at(F.array(*map(F.lit, ratios)), F.least(event + 1, F.lit(len(ratios))))
    return F.greatest(F.least(F.floor(now * ratio), F.lit(most)), F.lit(least)).cast("long")


def cell_size(df: DataFrame, axes: list[str], want: int, low: float, high: float, steps: int = 24) -> float:
    """The cell width between low and high that leaves about `want` occupied cells, by halving; one count a step."""
    for _ in range(steps):
        mid = (low + high) / 2
        n = df.select(*[F.floor(F.col(c) / mid).alias(c) for c in axes]).distinct().count()
        low, high = (mid, high) if n > want else (low, mid)
    return (low + high) / 2


def merge_directions(forward: DataFrame, reverse: DataFrame, least: float) -> DataFrame:
    """(pixel, label, source) of two label maps: forward labels stay; a reverse region fills the pixels that forward leaves
    open if at least that share of the region is open."""
    open_ = reverse.join(forward.select("pixel"), "pixel", "left_anti")
    share = reverse.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(open_.groupBy("label").agg(F.count(F.lit(1)).alias("o")), "label").filter(F.col("o") >= least * F.col("n"))
    fill = open_.join(share.select("label"), "label", "left_semi").select("pixel", "label", F.lit("reverse").alias("source"))
    return forward.select("pixel", "label", F.lit("forward").alias("source")).unionByName(fill)
