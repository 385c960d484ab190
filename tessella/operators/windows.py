"""Window operators. Every order ends in an id, so that ties have one result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalar import clip01, finite, smoothstep01
from tessella.staging import stage


def numbered(df: DataFrame, order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """Rows numbered from 0 in an order without ties; with a weight, its sum over the rows before. Ranges of the order
    are staged and sorted each on its own, and begin where the ranges before end: one task sees no more than a row for
    each range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    x, before = F.col(weight) if weight else F.lit(1), (Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.sum(x).alias("_sum"))
    start = sizes.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(*before)), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(*before)
    return ranged.join(F.broadcast(start), "_range").withColumn(name, F.col("_start") + F.coalesce(F.sum(x).over(own), F.lit(0))).drop("_range", "_start")


def quantiles(df: DataFrame, x: str, keys: list[str], named: dict[str, float]) -> DataFrame:
    """keys and the exact quantiles of each group's values of x, with linear interpolation; groups without values are
    left out. Distinct values are counted, and their counts summed by ranges of the order, so that no task holds a
    group's values, as percentile() does."""
    counts = df.select(*keys, F.col(x).cast("double").alias("_x")).filter("_x is not null").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"))
    at = numbered(counts, [*keys, "_x"], "_at", "_n")
    own = [F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]
    whole = stage(at.groupBy(*own).agg(F.min("_at").alias("_first"), F.sum("_n").alias("_rows")), "groups")
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    placed = at.join(whole, same) if keys else at.crossJoin(F.broadcast(whole))  # one row
    place = {name: F.lit(float(q)) * (F.col("_rows") - 1) for name, q in named.items()}
    value = lambda p: F.max(F.when(F.col("_at") - F.col("_first") <= p, F.col("_x")))
    got = placed.groupBy(*keys, "_rows").agg(*[e for name, p in place.items() for e in (value(F.floor(p)).alias(f"_lo_{name}"), value(F.ceil(p)).alias(f"_hi_{name}"))])
    lo, hi = (lambda name: F.col(f"_lo_{name}")), (lambda name: F.col(f"_hi_{name}"))
    return got.select(*keys, *[F.when(lo(name) == hi(name), lo(name)).otherwise((F.ceil(p) - p) * lo(name) + (p - F.floor(p)) * hi(name)).alias(name) for name, p in place.items()])


def normalize_by_quantile(df: DataFrame, x: str, keys: list[str], q: float = 0.95) -> DataFrame:
    """x over its group's quantile, in [0, 1]; a join with the quantiles, no window over the group's rows."""
    top = df.select(*keys).distinct().join(quantiles(df.withColumn(x, finite(F.col(x))), x, keys, {"top": q}), keys, "left")
    return df.join(top, keys).withColumn("norm", clip01(F.col(x) / F.greatest("top", F.lit(1e-6)))).drop("top")


def normalize_between(df: DataFrame, x: str, keys: list[str], low: float = 0.1, high: float = 0.9, smooth: bool = False, inverse: bool = False) -> DataFrame:
    b = df.select(*keys).distinct().join(quantiles(df, x, keys, {"lo": low, "hi": high}), keys, "left")
    t = F.when(F.col("hi") > F.col("lo"), (F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    t = smoothstep01(t) if smooth else clip01(t)
    return df.join(b, keys).withColumn("norm", 1 - t if inverse else t).drop("lo", "hi")


def trailing_mean(df: DataFrame, x: str, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn("smooth", F.avg(finite(F.col(x))).over(w))


def nearest(df: DataFrame, keys: list[str], depth: str, row: str) -> DataFrame:
    """The row of least depth of each key; ties to the lowest id. An aggregate, so nothing is sorted."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(depth, row))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, *[F.col("b")[c].alias(c) for c in rest])


def depth_band(df: DataFrame, keys: list[str], depth: str, band: float) -> DataFrame:
    low = df.groupBy(*keys).agg(F.min(depth).alias("low"))
    return df.join(low, keys).filter(F.col(depth) <= F.col("low") + band).drop("low")


def composite(df: DataFrame, keys: list[str], order: list[str], alpha: str, color: str, cap: float = 0.999, stop: float = 1e-4) -> DataFrame:
    """Front-to-back compositing: weight a * product of (1 - a) before; rows under 1/255 are skipped, and a key ends
    before the row that would leave a transmittance of `stop` or less."""
    w = Window.partitionBy(*keys).orderBy(*order)
    a = df.withColumn("a", F.least(F.col(alpha), F.lit(cap))).filter(F.col("a") >= 1 / 255)
    a = a.withColumn("after", F.exp(F.sum(F.log(1 - F.col("a"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))).filter(F.col("after") > stop)
    part = F.col("after") / (1 - F.col("a")) * F.col("a")
    return a.withColumn("part", part).groupBy(*keys).agg(F.sum(F.col("part") * F.col(color)).alias("color"), F.sum("part").alias("opacity"), F.count(F.lit(1)).alias("used"))


def composite_batches(df: DataFrame, keys: list[str], batch: Column, order: list[str], alpha: str, colors: list[str], cap: float = 0.999, stop: float = 1e-4) -> DataFrame:
    """composite() of several colours, in batches of the order (batch must not fall along it): a batch needs of those
    before it only what they let through, so these are summed first, one row for a key and batch; batches that nothing
    reaches are not looked into, and the others' rows are sorted each batch on its own, however long a key's list is.
    Any batches give the same rows: keys, the colours, opacity, used."""
    a = df.withColumn("_batch", batch).withColumn("a", F.least(F.col(alpha), F.lit(cap))).filter(F.col("a") >= 1 / 255)
    let = a.groupBy(*keys, "_batch").agg(F.sum(F.log(1 - F.col("a"))).alias("_log"))
    before = Window.partitionBy(*keys).orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)
    reached = let.withColumn("_carried", F.coalesce(F.sum("_log").over(before), F.lit(0.0))).filter(F.exp("_carried") > stop).drop("_log")
    own = Window.partitionBy(*keys, "_batch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = a.join(reached, [*keys, "_batch"]).withColumn("after", F.exp(F.col("_carried") + F.sum(F.log(1 - F.col("a"))).over(own))).filter(F.col("after") > stop)
    x = x.withColumn("_part", F.col("after") / (1 - F.col("a")) * F.col("a"))
    return x.groupBy(*keys).agg(*[F.sum(F.col("_part") * F.col(c)).alias(c) for c in colors], F.sum("_part").alias("opacity"), F.count(F.lit(1)).alias("used"))


def local_maxima(df: DataFrame, x: str, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    p, n = F.lag(x).over(w), F.lead(x).over(w)
    return df.withColumn("peak", p.isNull() | n.isNull() | ((F.col(x) > p) & (F.col(x) > n))).filter("peak").drop("peak")


def fill_gaps(df: DataFrame, x: str, keys: list[str], gap: float) -> DataFrame:
    """Keys and values, and a midpoint (half to even) where the next value is more than gap away."""
    nxt = F.lead(x).over(Window.partitionBy(*keys).orderBy(x))
    more = df.withColumn("nxt", nxt).filter(F.col("nxt") - F.col(x) > gap).select(*keys, F.rint((F.col(x) + F.col("nxt")) / 2).cast("long").alias(x))
    return df.select(*keys, F.col(x).cast("long").alias(x)).unionByName(more)


def first_of(df: DataFrame, key: list[str], row: str) -> DataFrame:
    """Distinct keys with the id of their first row and a dense number in the order of first rows. The numbering is
    over distinct keys only."""
    d = df.groupBy(*key).agg(F.min(row).alias("first"))
    return numbered(d, ["first"], "number")


def relabel(df: DataFrame, label: str) -> DataFrame:
    """Positive labels numbered from 1 in their order, 0 kept; a join with the distinct labels."""
    d = numbered(df.filter(F.col(label) > 0).select(label).distinct(), [label], "dense").withColumn("dense", F.col("dense") + 1)
    return df.join(d, label, "left").withColumn("dense", F.coalesce("dense", F.lit(0)))


def offsets(df: DataFrame, key: str, grid: DataFrame) -> DataFrame:
    """Exclusive running counts over all cells of the grid, empty ones included."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return numbered(grid.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0))), [key], "offset", "n")


def box_sum(df: DataFrame, x: str, keys: list[str], order: list[str], radius: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-radius, radius)
    return df.withColumn("box", F.sum(x).over(w))


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("b")).select(*key, *[F.col("b")[c].alias(c) for c in rest])


def interpolate(df: DataFrame, keys: list[str], order: list[str], x: str, n: int) -> DataFrame:
    """keys, order, part, x: each row and n - 1 places on the way to the next, on a Catmull-Rom curve; the ends of a
    series count twice, and its last row stands alone."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = lambda k: F.lag(x, -k).over(w)
    d = df.withColumn("_b", F.col(x).cast("double")).withColumn("_a", F.coalesce(at(-1), x)).withColumn("_c", at(1)).withColumn("_d", F.coalesce(at(2), at(1)))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.col("_c").isNull(), 0).otherwise(n - 1))))
    t, a, b, c, e = F.col("part") / float(n), F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d")
    curve = (b * 2 + (c - a) * t + (a * 2 - b * 5 + c * 4 - e) * t * t + (b * 3 - a - c * 3 + e) * t * t * t) / 2
    return d.select(*keys, *order, "part", F.when(F.col("part") == 0, b).otherwise(curve).alias(x))
