"""Plug-in rules that edit a table step by step, with running state in the rows themselves.

A strategy's `start` gives rows their state columns, `check` tells what they lack, and `after` takes a version of the
table and what a step has seen of its rows to the next version. State lies beside the values it is about, so that an
edit that clones, splits or removes rows keeps both in step, whatever other columns there are. Versions are staged by
whoever folds the steps (`play`); the draws of an edit come from ids and steps, so a replay gives the same versions."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.staging import stage, unstage

from . import edits
from .selection import uniform
from .windows import numbered


class Strategy:
    """Does nothing; what others build on."""

    needs: tuple[str, ...] = ()
    sees: tuple[str, ...] = ()

    def check(self, rows: DataFrame) -> None:
        lacks = [c for c in self.needs if c not in rows.columns]
        if lacks:
            raise ValueError(f"{type(self).__name__} needs the columns {', '.join(lacks)}")

    def start(self, rows: DataFrame) -> DataFrame:
        return rows

    def after(self, rows: DataFrame, seen: DataFrame, step: int) -> DataFrame:
        return rows


def play(strategy: Strategy, rows: DataFrame, steps: Iterable[tuple[int, DataFrame]]) -> DataFrame:
    """The version of the table after all steps (number, what it has seen); every version is staged, and the one before
    it deleted."""
    strategy.check(rows)
    now = stage(strategy.start(rows), "version")
    for step, seen in steps:
        lacks = [c for c in strategy.sees if c not in seen.columns]
        if lacks:
            raise ValueError(f"{type(strategy).__name__} must see {', '.join(lacks)} in step {step}")
        old, now = now, stage(strategy.after(now, seen, step), "version")
        unstage(old)
    return now


def normals(row: str, seed: int, n: int) -> list[Column]:
    """n independent standard normal draws of a row, from its hash."""
    draw = lambda k: uniform(row, seed + k)
    return [F.sqrt(-2 * F.log(1 - draw(2 * k))) * F.cos(2 * math.pi * draw(2 * k + 1)) for k in range(n)]


@dataclass
class Densify(Strategy):
    """Rows (id, x, y, z, log scales s0, s1, s2, quaternion qw, qx, qy, qz, opacity as a logit, anything else) that grow
    where they are seen with large gradients, and go where they are faint.

    A step sees (id, gx, gy, radius), rows of a picture of width by height pixels in one of `cameras`; gradients count
    in half pictures, radii in its longer side, unseen rows (radius 0 or less) not at all. After steps beyond `begin`
    that are multiples of `every` (at least `pause` after a reset), rows whose mean gradient is over `grow_gradient`
    are cloned if no scale is over grow_scale * scene, else split in two: places drawn from their own ellipsoid, scales
    over 1.6, opacities as before or, if `revised`, so that two let through as much as one. Before `radius_stop`, rows
    seen larger than `grow_radius` are split too. Then rows under `least` opacity go, and after the first reset those
    of too large scales or radii; ids are numbered anew in the order of (id, copy) and state begins anew. Every
    `reset_every` steps opacities are clamped to twice `least`. Steps from `end` on change nothing."""

    width: int
    height: int
    cameras: int = 1
    scene: float = 1.0
    least: float = 0.05
    grow_gradient: float = 0.0002
    grow_scale: float = 0.01
    grow_radius: float = 0.05
    most_scale: float = 0.1
    most_radius: float = 0.15
    radius_stop: int = 0
    begin: int = 500
    end: int = 15_000
    reset_every: int = 3000
    every: int = 100
    pause: int = 0
    revised: bool = False
    seed: int = 0

    needs = ("id", "x", "y", "z", "s0", "s1", "s2", "qw", "qx", "qy", "qz", "opacity")
    sees = ("id", "gx", "gy", "radius")
    state = ("grad", "n_seen", "radius")

    def start(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"grad": F.lit(0.0), "n_seen": F.lit(0).cast("long"), "radius": F.lit(0.0)})

    def after(self, rows: DataFrame, seen: DataFrame, step: int) -> DataFrame:
        if step >= self.end:
            return rows
        rows = self.met(rows, seen)
        if step > self.begin and step % self.every == 0 and step % self.reset_every >= self.pause:
            rows = self.start(self.pruned(self.grown(rows, step), step).drop(*self.state))
        return edits.reset(rows, "opacity", 2 * self.least) if step % self.reset_every == 0 else rows

    def met(self, rows: DataFrame, seen: DataFrame) -> DataFrame:
        gx, gy = F.col("gx") * self.width / 2 * self.cameras, F.col("gy") * self.height / 2 * self.cameras
        each = seen.filter("radius > 0").groupBy("id").agg(F.sum(F.sqrt(gx * gx + gy * gy)).alias("_g"), F.count(F.lit(1)).alias("_n"), F.max(F.col("radius") / max(self.width, self.height)).alias("_r"))
        x = rows.join(each, "id", "left")
        new = {"grad": F.col("grad") + F.coalesce("_g", F.lit(0.0)), "n_seen": F.col("n_seen") + F.coalesce("_n", F.lit(0)), "radius": F.greatest("radius", F.coalesce("_r", F.lit(0.0)))}
        return x.withColumns(new).select(*rows.columns)

    def _largest(self) -> Column:
        return F.exp(F.greatest("s0", "s1", "s2"))

    def grown(self, rows: DataFrame, step: int) -> DataFrame:
        """Every row as itself, a clone or two children, told by copy: 0, 1 (a clone), 2 and 3 (children)."""
        hot = F.col("grad") / F.greatest("n_seen", F.lit(1)) > self.grow_gradient
        small = self._largest() <= self.grow_scale * self.scene
        split = hot & ~small
        if step < self.radius_stop:
            split = split | (F.col("radius") > self.grow_radius)
        own = F.when(split, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(0)))
        x = rows.withColumn("copy", F.explode(F.concat(own, F.when(hot & small, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))))
        child = F.col("copy") >= 2
        x = x.withColumn("_name", F.concat_ws(":", F.col("id"), F.col("copy"), F.lit(step)))
        length = F.sqrt(sum((F.col(q) ** 2 for q in ("qw", "qx", "qy", "qz")), F.lit(0.0)))
        x = x.withColumns({f"_q{k}": F.col(q) / F.greatest(length, F.lit(1e-12)) for k, q in enumerate(("qw", "qx", "qy", "qz"))} | {f"_d{k}": d * F.exp(f"s{k}") for k, d in enumerate(normals("_name", self.seed, 3))})
        w, i, j, k = (F.col(f"_q{n}") for n in range(4))
        turn = [[1 - 2 * (j * j + k * k), 2 * (i * j - w * k), 2 * (i * k + w * j)], [2 * (i * j + w * k), 1 - 2 * (i * i + k * k), 2 * (j * k - w * i)], [2 * (i * k - w * j), 2 * (j * k + w * i), 1 - 2 * (i * i + j * j)]]
        place = {c: F.when(child, F.col(c) + sum((turn[a][b] * F.col(f"_d{b}") for b in range(3)), F.lit(0.0))).otherwise(F.col(c)) for a, c in enumerate("xyz")}
        sizes = {f"s{n}": F.when(child, F.col(f"s{n}") - math.log(1.6)).otherwise(F.col(f"s{n}")) for n in range(3)}
        let = F.sqrt(1 - 1 / (1 + F.exp(-F.col("opacity"))))  # half as much in each: 1 - o = (1 - o')**2
        faint = {"opacity": F.when(child, F.log((1 - let) / let)).otherwise(F.col("opacity"))} if self.revised else {}
        return x.withColumns(place | sizes | faint).select(*rows.columns, "copy")

    def pruned(self, rows: DataFrame, step: int) -> DataFrame:
        big = self._largest() > self.most_scale * self.scene
        if step < self.radius_stop:
            big = big | (F.col("radius") > self.most_radius)
        kept = edits.prune(rows, 1 / (1 + F.exp(-F.col("opacity"))), self.least, big, step > self.reset_every)
        named = numbered(kept, ["id", "copy"], "_new")
        return named.withColumn("id", F.col("_new")).drop("_new", "copy")
