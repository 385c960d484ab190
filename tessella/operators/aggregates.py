"""Grouped aggregates. Quantiles are exact, with linear interpolation; empty input gives zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import finite

from .windows import quantiles


def _beside(df: DataFrame, x: str, keys: list[str], named: dict[str, float], rest: list[Column]) -> DataFrame:
    """keys, the aggregates of rest, and quantiles of the finite values of x (null in groups without any)."""
    all_ = df.groupBy(*keys).agg(*rest)
    got = quantiles(df.select(*keys, finite(F.col(x)).alias("_v")), "_v", keys, named)
    got = got.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *named)
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return all_.join(got, same, "left").drop(*[f"_k{n}" for n in range(len(keys))])


def group_quantile(df: DataFrame, x: str, keys: list[str], q: float, name: str) -> DataFrame:
    """keys and the quantile of each group's finite values."""
    return _beside(df, x, keys, {name: q}, [F.count(F.lit(1)).alias("_rows")]).select(*keys, name)


def profile(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """count, min, q25, median, mean, q75, q90, max of the finite values of each group."""
    v = finite(F.col(x))
    got = _beside(df, x, keys, {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}, [F.count(v).alias("count"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max")])
    return got.select(*keys, "count", *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("min", "q25", "median", "mean", "q75", "q90", "max")])


def mad(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Median absolute deviation from the group's median: two passes, joined by group."""
    dev = df.join(group_quantile(df, x, keys, 0.5, "mid"), keys).withColumn("dev", F.abs(F.col(x) - F.col("mid")))
    return group_quantile(dev, "dev", keys, 0.5, "mad").withColumn("mad", F.coalesce("mad", F.lit(0.0)))


def weighted_mean(df: DataFrame, x: str, w: str, keys: list[str]) -> DataFrame:
    total = F.sum(w)
    return df.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col(x) * F.col(w)) / total).otherwise(0.0).alias("mean"), total.alias("weight"))


def majority(df: DataFrame, label: str, keys: list[str], weight: str | None = None, first: str | None = None) -> DataFrame:
    """The label of the largest count (or sum of weights) of each group, and its share. Ties go to the smallest label,
    or to the one that comes first by `first`."""
    w = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    votes = df.groupBy(*keys, label).agg(w.alias("w"), (F.min(first) if first else F.min(label)).alias("at"))
    win = F.max_by(F.struct(label, "w"), F.struct("w", F.negative("at") if first else F.negative(label)))
    return votes.groupBy(*keys).agg(win.alias("m"), F.sum("w").alias("all")).select(*keys, F.col("m")[label].alias(label), F.col("m.w").alias("votes"), (F.col("m.w") / F.col("all")).alias("share"))


def set_overlap(df: DataFrame, owner: str, item: str) -> DataFrame:
    """IoU of the item sets of each pair of owners that share an item."""
    s = df.select(owner, item).distinct()
    size = s.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
    a, b = s.withColumnRenamed(owner, "a"), s.withColumnRenamed(owner, "b")
    both = a.join(b, item).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    j = both.join(size.select(F.col(owner).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(owner).alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("iou"))


def merge_partials(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Running state (n, total, top) of keys, as two partial aggregates merge."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"))


def scatter_to_parts(df: DataFrame, parts: list[str], x: str, w: str) -> DataFrame:
    """Mean weighted by w, and largest value floored at zero, over the rows that name a part in any of the columns."""
    rows = df.select(F.explode(F.array(*parts)).alias("part"), x, F.greatest(F.col(w), F.lit(1e-12)).alias("w"))
    return rows.groupBy("part").agg((F.sum(F.col(x) * F.col("w")) / F.sum("w")).alias("mean"), F.greatest(F.max(x), F.lit(0.0)).alias("top"))


def attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Group figures back on rows."""
    return df.join(stats, keys, "left")


def rank_window(keys: list[str], *order: Column):
    return Window.partitionBy(*keys).orderBy(*order)
