"""The densifying strategy over some steps against a plain replay of its rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import strategy

SCHEMA = "id long, x double, y double, z double, s0 double, s1 double, s2 double, qw double, qx double, qy double, qz double, opacity double, tag string"
RULES = {"width": 20, "height": 10, "cameras": 2, "grow_gradient": 1.0, "grow_scale": 0.3, "grow_radius": 0.5, "most_scale": 0.9, "most_radius": 0.8, "radius_stop": 7, "begin": 1, "end": 9, "reset_every": 4, "every": 2, "pause": 0}


def rows():
    rnd = random.Random(1)
    return [(k, *(rnd.uniform(-1, 1) for _ in range(3)), *(math.log(rnd.choice([0.05, 0.2, 0.5, 1.2])) for _ in range(3)), *(rnd.gauss(0, 1) for _ in range(4)), rnd.uniform(-4, 4), f"t{k}") for k in range(24)]


def seen(step, n):
    rnd = random.Random(step)
    return [(rnd.randrange(n), rnd.uniform(-0.1, 0.1), rnd.uniform(-0.1, 0.1), rnd.choice([0.0, -1.0, 3.0, 9.0, 17.0])) for _ in range(60)]


def replay(own, steps, revised):
    """id to [scales, opacity, tag, grad, n, radius], without places."""
    now = {r[0]: [list(r[4:7]), r[11], r[12], 0.0, 0, 0.0] for r in own}
    for step, views in steps:
        if step >= 9:
            continue
        for i, gx, gy, radius in views:
            if radius > 0 and i in now:
                now[i][3] += math.hypot(gx * 10 * 2, gy * 5 * 2)
                now[i][4] += 1
                now[i][5] = max(now[i][5], radius / 20)
        if step > 1 and step % 2 == 0:
            out = []
            for i, (s, o, tag, g, n, radius) in sorted(now.items()):
                hot, small = g / max(n, 1) > 1.0, math.exp(max(s)) <= 0.3
                split = hot and not small or step < 7 and radius > 0.5
                half = 1 - math.sqrt(1 - 1 / (1 + math.exp(-o)))
                child = [[v - math.log(1.6) for v in s], math.log(half / (1 - half)) if revised else o, tag, 0, 0, radius]
                out += [[list(s), o, tag, 0, 0, radius]] * (not split) + [[list(s), o, tag, 0, 0, radius]] * (hot and small) + [child, child] * split
            kept = [r for r in out if 1 / (1 + math.exp(-r[1])) >= 0.05 and not (step > 4 and (math.exp(max(r[0])) > 0.9 or step < 7 and r[5] > 0.8))]
            now = {k: [list(r[0]), r[1], r[2], 0.0, 0, 0.0] for k, r in enumerate(kept)}
        if step % 4 == 0:
            for r in now.values():
                r[1] = min(r[1], math.log(0.1 / 0.9))
    return now


@pytest.mark.parametrize("revised", [False, True])
def test_steps_equal_a_replay(spark, revised):
    steps = [(k, seen(k, 24)) for k in range(1, 10)]
    frames = [(k, spark.createDataFrame(v, "id long, gx double, gy double, radius double")) for k, v in steps]
    play = lambda: sorted(map(tuple, strategy.play(strategy.Densify(**RULES, revised=revised), spark.createDataFrame(rows(), SCHEMA), frames).collect()))
    got, want = play(), replay(rows(), steps, revised)
    assert [r[0] for r in got] == list(range(len(want))) and len(want) > 24
    for r in got:
        s, o, tag, g, n, radius = want[r[0]]
        assert list(r[4:7]) == pytest.approx(s) and r[11] == pytest.approx(o) and r[12] == tag and r[13] == pytest.approx(g) and r[14] == n and r[15] == pytest.approx(radius)
    assert play() == got  # draws come from ids and steps


def test_children_lie_in_their_ellipsoids(spark):
    own = [(k, 1.0, 2.0, 3.0, math.log(2.0), math.log(0.5), math.log(0.1), math.cos(0.4), 0.0, 0.0, math.sin(0.4), 0.0, "") for k in range(4000)]
    d = strategy.Densify(width=2, height=2, grow_gradient=0.5, seed=3)
    hot = d.start(spark.createDataFrame(own, SCHEMA)).withColumn("grad", F.lit(1.0))
    got = d.grown(hot, 600).toPandas()
    assert len(got) == 8000 and set(got["copy"]) == {2, 3}
    c, s = math.cos(0.8), math.sin(0.8)
    u, v, w = (got["x"] - 1) * c + (got["y"] - 2) * s, -(got["x"] - 1) * s + (got["y"] - 2) * c, got["z"] - 3
    assert [u.std(), v.std(), w.std()] == pytest.approx([2.0, 0.5, 0.1], rel=0.05) and abs(u.mean()) < 0.1
    assert abs(u.corr(v)) < 0.05 and not got[["x", "y", "z"]].duplicated().any()


def test_lacking_columns_and_plain_strategy(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    with pytest.raises(ValueError, match="qw"):
        strategy.play(strategy.Densify(width=1, height=1), df.drop("qw"), [])
    with pytest.raises(ValueError, match="radius in step 3"):
        strategy.play(strategy.Densify(width=1, height=1), df, [(3, spark.createDataFrame([], "id long, gx double, gy double"))])
    assert sorted(map(tuple, strategy.play(strategy.Strategy(), df, [(1, df)]).collect())) == sorted(rows())
    none = spark.createDataFrame([], "id long, gx double, gy double, radius double")
    assert strategy.play(strategy.Densify(**RULES), df.limit(0), [(2, none)]).collect() == []
