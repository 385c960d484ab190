"""Edits of row sets that keep every other column: clones, removals, moves onto drawn rows, resets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import uniform


def clone(df: DataFrame, when: Column) -> DataFrame:
    """df and once more the rows for which it holds, told by copy."""
    return df.withColumn("copy", F.lit(0)).unionByName(df.filter(when).withColumn("copy", F.lit(1)))


def grow(df: DataFrame, hot: Column, large: Column, size: str, by: float) -> DataFrame:
    """Hot small rows are cloned, hot large ones become two of a size divided by `by`; new rows are not looked at again."""
    x = df.withColumn("_hot", hot).withColumn("_large", large)
    x = x.withColumn("copy", F.explode(F.when(F.col("_hot"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return x.withColumn(size, F.when(F.col("_hot") & F.col("_large"), F.col(size) / by).otherwise(F.col(size))).drop("_hot", "_large")


def prune(df: DataFrame, opacity: Column, least: float, too_big: Column, past_reset: bool) -> DataFrame:
    """Rows that are opaque enough and, once past a reset, not too big."""
    gone = opacity < least
    return df.filter(~(gone | too_big if past_reset else gone))


def reset(df: DataFrame, logit: str, value: float) -> DataFrame:
    """Opacities, as logits, clamped to a value."""
    return df.withColumn(logit, F.least(F.col(logit), F.lit(math.log(value / (1 - value)))))


def prefix_sums(df: DataFrame, row: str, x: str, parts: int = 64) -> DataFrame:
    """df with upto: the sum of x over the rows up to each, in the order of (row % parts, row). A window holds a part of
    the rows, and one more the parts' sums."""
    d = df.withColumn("_part", F.pmod(F.col(row), F.lit(parts)))
    inside = F.sum(x).over(Window.partitionBy("_part").orderBy(row).rowsBetween(Window.unboundedPreceding, 0))
    sums = d.groupBy("_part").agg(F.sum(x).alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # `parts` rows
    base = sums.select("_part", F.coalesce(before, F.lit(0.0)).alias("_before"))
    return d.withColumn("_in", inside).join(F.broadcast(base), "_part").withColumn("upto", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def draw(live: DataFrame, row: str, weight: str, draws: DataFrame, draw: str, seed: int, cells: int = 4096, parts: int = 64) -> DataFrame:
    """(draw, row): for each draw a live row, in proportion to the weights, with replacement. The running sums are cut into
    cells; a row is in every cell that its stretch meets, and a draw meets only the rows of its own."""
    w = prefix_sums(live.filter(F.col(weight) > 0).select(row, F.col(weight).cast("double").alias("_w")), row, "_w", parts)
    total = w.agg(F.sum("_w").alias("_total"))
    w = w.join(F.broadcast(total))  # one row
    cell = lambda c: F.least(F.floor(c / F.col("_total") * cells), F.lit(cells - 1))
    lo = F.col("upto") - F.col("_w")
    w = w.select(row, lo.alias("_lo"), F.col("upto").alias("_hi"), F.explode(F.sequence(cell(lo), cell(F.col("upto")))).alias("_cell"))
    d = draws.select(F.col(draw).alias("_draw")).join(F.broadcast(total)).withColumn("_t", uniform("_draw", seed) * F.col("_total"))
    d = d.select("_draw", "_t", cell(F.col("_t")).alias("_cell"))
    met = d.join(w, "_cell").filter((F.col("_t") >= F.col("_lo")) & (F.col("_t") < F.col("_hi")))
    return met.groupBy("_draw").agg(F.min(row).alias(row)).select(F.col("_draw").alias(draw), row)


def relocated(opacity: Column, size: Column, n: Column, most: int = 51) -> tuple[Column, Column]:
    """Opacity and size of each of n rows that stand for one: n of that opacity, one behind the other, cover as much as the
    one did, and their sizes keep the sum of the densities."""
    k = F.greatest(F.least(n, F.lit(most)), F.lit(1)).cast("int")
    new = 1 - F.pow(1 - opacity, 1.0 / k)
    term = lambda i, j: F.when(j % 2 == 0, 1.0).otherwise(-1.0) / F.sqrt(j + 1.0) * F.pow(new, j + 1.0) * choose(i - 1, j)
    inner = lambda i: F.aggregate(F.sequence(F.lit(0), i - 1), F.lit(0.0), lambda a, j: a + term(i, j))
    total = F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda a, i: a + inner(i))
    return new, opacity / total * size


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient."""
    return F.when(k == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda a, i: a * (n - k + i) / i))


def relocate(df: DataFrame, row: str, opacity: str, size: str, least: float, seed: int) -> DataFrame:
    """Rows under an opacity move onto live ones drawn by opacity; a row that n others moved onto shares its opacity and
    size with them (relocated()); of is the row that a row's values come from."""
    live = df.filter(F.col(opacity) > least)
    moved = draw(live, row, opacity, df.filter(F.col(opacity) <= least).select(F.col(row).alias("_dead")), "_dead", seed)
    times = moved.groupBy(row).agg((F.count(F.lit(1)) + 1).alias("_n"))
    new_opacity, new_size = relocated(F.col(opacity), F.col(size), F.coalesce("_n", F.lit(1)))
    shared = live.join(times, row, "left").withColumn("_o", new_opacity).withColumn("_s", new_size).select(F.col(row).alias("of"), F.when(F.col("_n").isNull(), F.col(opacity)).otherwise(F.col("_o")).alias(opacity), F.when(F.col("_n").isNull(), F.col(size)).otherwise(F.col("_s")).alias(size))
    whose = moved.select(F.col("_dead").alias(row), F.col(row).alias("of")).unionByName(live.select(row, F.col(row).alias("of")))
    return whose.join(shared, "of").select(row, "of", opacity, size)
