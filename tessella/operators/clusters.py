"""Clusterings: k-means codebooks, two-component mixtures, density clusters, thresholded merging of components."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.staging import reread

from .graph import components, cut
from .windows import quantiles

SPLIT, LEVELS = 4, 10


def _nearest(xs: list[str], centres: list[tuple[float, ...]]) -> Column:
    """Number of the nearest centre, ties to the lowest."""
    each = []
    for k, centre in enumerate(centres):
        d = sum(((F.col(x) - F.lit(c)) * (F.col(x) - F.lit(c)) for x, c in zip(xs, centre, strict=True)), F.lit(0.0))
        each.append(F.struct(d.alias("d"), F.lit(k).alias("k")))
    return (F.least(*each) if len(each) > 1 else each[0])["k"]


def k_means(df: DataFrame, row: str, xs: list[str], k: int, rounds: int) -> tuple[DataFrame, list[tuple[float, ...]]]:
    """df with cluster, and the k centres. The centres start at the k lowest ids; one without rows stays where it is.
    Only the centres (k by the number of columns) come to the driver."""
    centres = [tuple(map(float, r)) for r in df.orderBy(row).select(*xs).limit(k).collect()]
    if not centres:
        return df.withColumn("cluster", F.lit(None).cast("int")), []
    for _ in range(rounds):
        moved = df.groupBy(_nearest(xs, centres).alias("_k")).agg(*[F.avg(x) for x in xs]).collect()
        for r in moved:
            centres[r[0]] = tuple(map(float, r[1:]))
    return df.withColumn("cluster", _nearest(xs, centres)), centres


def two_gaussians(df: DataFrame, x: str, w: str, rounds: int, least: int = 20) -> dict[str, float] | None:
    """Weighted two-component mixture by expectation maximisation, from the quantiles 0.3 and 0.8 with shares 0.55 and
    0.45; None for fewer than `least` rows of positive weight. Every round is one aggregation of six sums."""
    df = df.filter((F.col(w) > 0) & F.col(x).isNotNull() & ~F.isnan(x)).select(F.col(x).cast("double").alias("x"), F.col(w).cast("double").alias("w"))
    n, spread = df.agg(F.count("*"), F.stddev_pop("x")).first()
    if n < max(least, 1):
        return None
    low, high = quantiles(df, "x", [], {"low": 0.3, "high": 0.8}).first()
    s = max(spread, 1e-6)
    m = [(0.55, low, s), (0.45, high, s)]
    for _ in range(rounds):
        dens = [F.lit(p / sd) * F.exp(F.lit(-0.5) * ((F.col("x") - mu) / sd) * ((F.col("x") - mu) / sd)) for p, mu, sd in m]
        total = F.greatest(dens[0] + dens[1], F.lit(1e-300))
        r = [F.col("w") * d / total for d in dens]
        got = df.agg(*[F.sum(e) for q in r for e in (q, q * F.col("x"), q * F.col("x") * F.col("x"))]).first()
        whole = got[0] + got[3]
        m = []
        for a, b, c in (got[:3], got[3:]):
            a = max(a, 1e-12)
            m.append((a / whole, b / a, max(math.sqrt(max(c / a - (b / a) ** 2, 0.0)), 1e-6)))
    return {f"{name}{k}": v for k, part in enumerate(m) for name, v in zip(("share", "mean", "sd"), part, strict=True)}


def density_clusters(links: DataFrame, points: DataFrame, row: str, least: int) -> DataFrame:
    """(row, cluster) of the points that belong to a cluster, from links (a, b), both ways, between points in reach.
    A point with `least` in reach, itself included, is a core; linked cores form clusters, named by their lowest core;
    another point joins the lowest cluster of the cores in its reach."""
    links = cut(links)
    many = links.groupBy(F.col("a").alias(row)).agg((F.count("*") + 1).alias("n")).filter(F.col("n") >= least)
    core = cut((many if least > 1 else points).select(row))
    from_core = links.join(core.withColumnRenamed(row, "a"), "a")
    inner = from_core.join(core.withColumnRenamed(row, "b"), "b").select("a", "b")
    root = components(inner).select(F.col("node").alias(row), F.col("root").alias("cluster"))
    root = cut(core.join(root, row, "left").select(row, F.coalesce("cluster", row).alias("cluster")))
    edge = from_core.join(root.withColumnRenamed(row, "a"), "a").join(core.withColumnRenamed(row, "b"), "b", "left_anti")
    return root.unionByName(edge.groupBy(F.col("b").alias(row)).agg(F.min("cluster").alias("cluster")))


def _gap(of: str, to: str, axes: list[str], far: bool = False) -> Column:
    """Squared distance of two boxes (structs with lows and highs of the axes), or of their furthest corners."""
    at = lambda n, k, c: F.col(f"{n}.{k}_{c}")
    if far:
        each = [F.greatest(at(of, "hi", c) - at(to, "lo", c), at(to, "hi", c) - at(of, "lo", c)) for c in axes]
    else:
        each = [F.greatest(at(of, "lo", c) - at(to, "hi", c), at(to, "lo", c) - at(of, "hi", c), F.lit(0.0)) for c in axes]
    return sum(e * e for e in each[1:]) + each[0] * each[0] if len(each) > 1 else each[0] * each[0]


def density_clusters_within(points: DataFrame, row: str, axes: list[str], radius: float, least: int) -> DataFrame:
    """density_clusters() of the points whose distance is the radius at most, without the list of such pairs, which grows
    with the square of a crowd. Cells are so small that their points are all in reach of each other: the points of a cell
    with `least` of them are cores, and only the others, fewer than `least` to a cell, look at the cells around. Cores
    of a cell are linked, so cells are: by boxes of their cores if these are wholly in reach, else by ever smaller boxes
    (`SPLIT` to an axis) of those that may hold a pair in reach. Rows without a finite place belong to no cluster."""
    far, reach = radius * radius, math.ceil(math.sqrt(len(axes)) * (1 + 1e-9))
    width = radius / math.sqrt(len(axes)) * (1 - 1e-9)
    key = [F.col(c) for c in axes]
    box = F.struct(*[e for c in axes for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    known = points.filter(" and ".join(f"{c} is not null and abs({c}) < double('Infinity')" for c in axes))
    x = known.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"))
    x = cut(x.withColumn("cell", F.array(*[F.floor(k / width) for k in key])).withColumn("place", F.monotonically_increasing_id()))
    sizes = x.groupBy("cell").agg(F.sum("n").alias("rows"), box.alias("box"))
    # rounding of large coordinates can make a cell wider than it should be: its places then stand alone
    whole = sizes.select("cell", "rows", (_gap("box", "box", axes, True) <= far).alias("tight"))
    x = cut(x.join(whole, "cell").withColumn("own", F.when(F.col("tight"), F.lit(-1).cast("bigint")).otherwise(F.col("place"))).withColumn("dense", F.col("tight") & (F.col("rows") >= least)))
    around = F.array(*[F.array(*[F.col("cell")[k] + o for k, o in enumerate(away)]) for away in product(range(-reach, reach + 1), repeat=len(axes))])
    sparse = x.filter("not dense").select(F.col("place").alias("p"), *[k.alias(f"p_{c}") for k, c in zip(key, axes, strict=True)], F.explode(around).alias("cell"))
    d2 = sum((F.col(f"p_{c}") - F.col(c)) * (F.col(f"p_{c}") - F.col(c)) for c in axes)
    near = cut(sparse.join(x.select("cell", "place", "n", *axes), "cell").filter(d2 <= far).select("p", "place", "n"))
    more = near.groupBy(F.col("p").alias("place")).agg(F.sum("n").alias("in_reach")).filter(F.col("in_reach") >= least).select("place")
    core = cut(x.filter("dense").unionByName(x.filter("not dense").join(more, "place", "left_semi").select(x.columns)).select("cell", "own", "place", "first", *axes))
    groups = cut(core.groupBy("cell", "own").agg(F.min("first").alias("g"), box.alias("box")))
    held = core.join(groups.select("cell", "own", "g", "box"), ["cell", "own"])
    # every axis of a group's box is cut into as many parts at each level; a part has the box of its cores
    part = lambda n: F.array(*[F.floor(F.least((F.col(c) - F.col(f"box.lo_{c}")) / F.greatest(F.col(f"box.hi_{c}") - F.col(f"box.lo_{c}"), F.lit(1e-300)), F.lit(1 - 2.0**-50)) * n) for c in axes])
    zero = F.array(*[F.lit(0).cast("bigint")] * len(axes))
    a = groups.select(F.col("g").alias("a"), F.col("box").alias("box_a"), F.explode(around).alias("cell"))
    pairs = a.join(groups.select("cell", F.col("g").alias("b"), F.col("box").alias("box_b")), "cell").filter("a < b").select("a", "b", "box_a", "box_b", zero.alias("part_a"), zero.alias("part_b"))
    links, level = [], 0
    while True:
        pairs = cut(pairs.filter(_gap("box_a", "box_b", axes) <= far).withColumn("sure", _gap("box_a", "box_b", axes, True) <= far))
        links.append(cut(pairs.filter("sure").select("a", "b").distinct()))
        open_ = pairs.join(links[-1], ["a", "b"], "left_anti").select("a", "b", "part_a", "part_b")
        if not open_.limit(1).count():
            break
        level += 1
        if level > LEVELS:  # cores too near to be told apart by parts: each pair of them
            side = lambda s: held.select(F.col("g").alias(s), part(SPLIT ** (level - 1)).alias(f"part_{s}"), F.struct(*[e for c in axes for e in (F.col(c).alias(f"lo_{c}"), F.col(c).alias(f"hi_{c}"))]).alias(f"box_{s}"))  # noqa: E731, B023
            last = open_.join(side("a"), ["a", "part_a"]).join(side("b"), ["b", "part_b"]).filter(_gap("box_a", "box_b", axes) <= far)
            links.append(cut(last.select("a", "b").distinct()))
            break
        up = lambda s: F.transform(f"part_{s}", lambda v: F.floor(v / SPLIT))
        parts = cut(held.select("g", part(SPLIT**level).alias("part"), *axes).groupBy("g", "part").agg(box.alias("box")))
        side = lambda s: parts.select(F.col("g").alias(s), F.col("part").alias(f"part_{s}"), F.col("box").alias(f"box_{s}")).withColumn(f"up_{s}", up(s))  # noqa: E731, B023
        open_ = open_.withColumnsRenamed({"part_a": "up_a", "part_b": "up_b"})
        pairs = open_.join(side("a"), ["a", "up_a"]).join(side("b"), ["b", "up_b"]).select("a", "b", "box_a", "box_b", "part_a", "part_b")
    root = components(reread(links)).select(F.col("node").alias("g"), F.col("root").alias("cluster"))
    named = cut(held.select("place", "g").join(root, "g", "left").select("place", F.coalesce("cluster", "g").alias("cluster")))
    edge = near.join(named, "place").join(core.select(F.col("place").alias("p")), "p", "left_anti").groupBy(F.col("p").alias("place")).agg(F.min("cluster").alias("cluster"))
    placed = x.select("place", *axes).join(named.unionByName(edge), "place").drop("place")
    return known.select(row, *axes).join(placed, axes).select(row, "cluster")


def merge_components(edges: DataFrame, thresholds: Iterable[float], least: float) -> DataFrame:
    """(node, root) from edges (a, b, score, confidence): for one threshold after another, the pairs of components
    whose confidence-weighted mean score reaches it are joined; pairs of less confidence than `least` do not count."""
    pairs = cut(edges.select("a", "b", "score", "confidence"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = cut(nodes.withColumn("root", F.col("node")))
    for t in thresholds:
        to = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))  # noqa: E731, B023
        x = pairs.join(to("a"), "a").join(to("b"), "b").filter("_a <> _b")
        x = x.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        x = x.agg((F.sum(F.col("score") * F.col("confidence")) / F.sum("confidence")).alias("mean"), F.sum("confidence").alias("c"))
        up = components(x.filter((F.col("c") >= least) & (F.col("mean") >= t)).select("a", "b"))
        up = up.select(F.col("node").alias("root"), F.col("root").alias("up"))
        label = cut(label.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
    return label
