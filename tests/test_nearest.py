"""Nearest triangles and reparenting against dense searches."""

import math

import numpy as np
import pytest

from tessella.operators import nearest

CORNER = "struct<x: double, y: double, z: double>"
SCHEMA = f"face long, a {CORNER}, b {CORNER}, c {CORNER}"


def closest(p, a, b, c):
    """By the corners, points of the sides and the foot on the plane."""
    found = []
    n = np.cross(b - a, c - a)
    if n @ n > 0:
        q = p - n * ((p - a) @ n) / (n @ n)
        w = np.linalg.lstsq(np.column_stack((b - a, c - a)), q - a, rcond=None)[0]
        if w.min() >= 0 and w.sum() <= 1:
            found.append((np.linalg.norm(p - q), (1 - w.sum(), *w)))
    for k, (u, v) in enumerate(((a, b), (b, c), (c, a))):
        t = min(1.0, max(0.0, (p - u) @ (v - u) / ((v - u) @ (v - u)))) if (v - u) @ (v - u) else 0.0
        w = [0.0] * 3
        w[k], w[(k + 1) % 3] = 1 - t, t
        found.append((np.linalg.norm(p - u - t * (v - u)), tuple(w)))
    return min(found)


def meshes():
    rnd = np.random.default_rng(4)
    some = rnd.normal(0, 5, (80, 1, 3)) + rnd.normal(0, 1, (80, 3, 3))
    small = rnd.normal(3, 0.01, (300, 1, 3)) + rnd.normal(0, 0.004, (300, 3, 3))  # a dense cell
    wide = rnd.normal(0, 40, (6, 3, 3))
    flat = np.repeat(rnd.normal(0, 5, (5, 1, 3)), 3, 1)  # no area, no length
    flat[1:3, 2] += 1.0
    return np.concatenate((some, small, wide, flat, some[:3]))  # and equal ones


def frame(spark, tris):
    return spark.createDataFrame([(k, *[tuple(map(float, v)) for v in t]) for k, t in enumerate(tris)], SCHEMA)


@pytest.mark.parametrize("leaf", [32, 3])
def test_nearest_equals_dense_search(spark, leaf):
    tris, rnd = meshes(), np.random.default_rng(5)
    points = np.concatenate((rnd.normal(0, 6, (60, 3)), rnd.normal(3, 0.02, (30, 3)), [[1e4, -2e5, 3e3], [0, 0, 1e7]], tris[:4, 0]))
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)] + [(999, None, 1.0, 1.0)], "point long, x double, y double, z double")
    got = {r.point: r for r in nearest.nearest_triangles(df, frame(spark, tris), leaf=leaf).collect()}
    assert set(got) == set(range(len(points)))
    for k, p in enumerate(points):
        dense = [closest(p, *t)[0] for t in tris]
        r = got[k]
        assert r.distance == pytest.approx(min(dense), rel=1e-9, abs=1e-9) and dense[r.face] == pytest.approx(min(dense), rel=1e-9, abs=1e-9)
        assert np.linalg.norm(p - np.array([r.wa, r.wb, r.wc]) @ tris[r.face]) == pytest.approx(r.distance, rel=1e-6, abs=1e-9) and min(r.wa, r.wb, r.wc) >= 0


def test_no_triangles_or_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "point long, x double, y double, z double")
    none = frame(spark, [])
    assert nearest.nearest_triangles(df, none).collect() == [] and nearest.nearest_triangles(df.limit(0), frame(spark, meshes())).collect() == []


def test_children_are_bound_to_the_new_mesh(spark):
    rnd = np.random.default_rng(6)
    tris = rnd.normal(0, 5, (40, 1, 3)) + rnd.normal(0, 1, (40, 3, 3))
    rows = [(k, *map(float, np.concatenate((rnd.normal(0, 5, 3), rnd.uniform(0.01, 1, 2), rnd.normal(0, 1, 3))))) for k in range(50)]
    df = spark.createDataFrame(rows, "child long, x double, y double, z double, sx double, sy double, ux double, uy double, uz double")
    logit = lambda x: math.log(min(max(x, 1e-4), 1 - 1e-4) / (1 - min(max(x, 1e-4), 1 - 1e-4)))
    for r in nearest.reparented(df, frame(spark, tris), 0.1, 2.0).collect():
        _, *p, sx, sy, ux, uy, uz = rows[r.child]
        d, w = min(closest(np.array(p), *t) for t in tris)
        assert r.distance == pytest.approx(d)
        a, b, c = tris[r.face]
        e, n = (b - a) / np.linalg.norm(b - a), np.cross(b - a, c - a)
        radius = np.linalg.norm(n) / sum(np.linalg.norm(x) for x in (b - a, c - a, c - b))
        axis, up = np.array([ux, uy, uz]) / np.linalg.norm([ux, uy, uz]), n / np.linalg.norm(n)
        turn = np.array([axis @ e, axis @ np.cross(up, e)])
        both = w[1] + w[2]
        want = [logit(both), logit(w[1] / both if both > 1e-6 else 0.5), logit((sx / radius - 0.1) / 1.9), logit((sy / radius - 0.1) / 1.9), *(turn / np.linalg.norm(turn))]
        assert np.allclose([r.uv_sum, r.u_ratio, r.scale_x, r.scale_y, r.turn_x, r.turn_y], want, atol=1e-6)
        assert r.scale_clamped == any(not 1e-4 <= (s / radius - 0.1) / 1.9 <= 1 - 1e-4 for s in (sx, sy))
