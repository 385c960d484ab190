"""Camera frames and vertices on patches, against numpy."""

import numpy as np
import pytest

from tessella.operators import cameras, patches


def poses(seed, n, tilt):
    rnd = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        q = np.linalg.qr(rnd.normal(size=(3, 3)) * 0.4 + tilt)[0]
        out.append((q * np.sign(np.linalg.det(q)), rnd.normal(0, 4, 3) + [3, 1, -2]))
    return out


@pytest.mark.parametrize("strict, center", [(False, "focus"), (True, "poses"), (True, "focus")])
@pytest.mark.parametrize("seed", [1, 2])
def test_similarity_equals_numpy(spark, seed, strict, center):
    own = poses(seed, 21 + seed, np.random.default_rng(9).normal(size=(3, 3)))
    df = spark.createDataFrame([(*map(float, R.ravel()), *map(float, t)) for R, t in own], ", ".join(f"{c} double" for c in [*cameras.ROTATION, *cameras.PLACE]))
    m = cameras.similarity(df, strict, center)
    got = np.array([[m.first()[f"m{i}{j}"] for j in range(4)] for i in range(3)])
    up = -np.mean([R[:, 1] for R, _ in own], axis=0)
    up /= np.linalg.norm(up)
    v, c = np.cross(up, [0, -1, 0]), -up[1]
    K = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    turn = np.eye(3) + K + K @ K / (1 + c)
    assert np.allclose(turn @ up, [0, -1, 0])
    t, f = np.array([turn @ t for _, t in own]), np.array([turn @ R[:, 2] for R, _ in own])
    middle = np.median(t - (f * t).sum(1)[:, None] * f if center == "focus" else t, axis=0)
    scale = 1 / (np.max if strict else np.median)(np.linalg.norm(t - middle, axis=1))
    assert np.allclose(got[:, :3], turn * scale, atol=1e-9) and np.allclose(got[:, 3], -middle * scale, atol=1e-9) and m.first()["scale"] == pytest.approx(scale)
    p = spark.createDataFrame([(7, 1.0, 2.0, 3.0)], "id long, x double, y double, z double")
    r = cameras.moved(p, m).first()
    assert r.id == 7 and np.allclose([r.x, r.y, r.z], got[:, :3] @ [1, 2, 3] + got[:, 3])


def test_upside_down_and_wrong_center(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0, float(k), 1.0, 2.0) for k in range(3)], ", ".join(f"{c} double" for c in [*cameras.ROTATION, *cameras.PLACE]))
    r = cameras.similarity(df, True, "poses").first()
    assert np.allclose([r.m00, r.m11, r.m22, r.m01, r.scale], [-1.0, 1.0, 1.0, 0.0, 1.0])
    with pytest.raises(ValueError):
        cameras.similarity(df, center="middle")


def test_vertices_move_onto_their_patches(spark):
    rnd = np.random.default_rng(3)
    v = [(k, *map(float, rnd.normal(size=3))) for k in range(40)]
    f = [(k, *map(int, rnd.choice(40, 3, replace=False))) for k in range(30)]
    n = rnd.normal(size=(4, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    d = rnd.normal(size=4)
    own = {k: int(rnd.integers(0, 4)) for k, *_ in f if k % 9}
    got = patches.project_vertices(
        spark.createDataFrame(v, "vertex long, x double, y double, z double"), spark.createDataFrame(f, "face long, v0 long, v1 long, v2 long"), ["v0", "v1", "v2"],
        spark.createDataFrame(list(own.items()), "face long, patch long"), spark.createDataFrame([(k, *map(float, n[k]), float(d[k])) for k in range(4)], "patch long, nx double, ny double, nz double, d double"), 0.05,
    )
    got, kinds = {r.vertex: r for r in got.collect()}, set()
    for k, *p in v:
        p, mine = np.array(p), {own.get(g) for g, *c in f if k in c}
        want = p
        if mine and None not in mine:
            a, b = n[sorted(mine)], d[sorted(mine)]
            want = p - (a[0] @ p + b[0]) * a[0] if len(mine) == 1 else np.linalg.solve(a.T @ a + 0.05 * np.eye(3), -a.T @ b + 0.05 * p)
            kinds.add(min(len(mine), 2))
        assert np.allclose([got[k].x, got[k].y, got[k].z, got[k].moved], [*want, np.linalg.norm(want - p)], atol=1e-9)
    assert len(got) == 40 and kinds == {1, 2}
