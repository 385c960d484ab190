"""Robust fits and depth planes against numpy, group by group."""

import math

import numpy as np

from tessella.operators import planes


def plane(p, w):
    mid = (p * w[:, None]).sum(0) / w.sum()
    n = np.linalg.eigh(((p - mid) * w[:, None]).T @ (p - mid))[1][:, 0]
    return mid, n * np.sign(n[np.argmax(np.abs(n))])


def test_robust_fit_equals_numpy(spark):
    rnd = np.random.default_rng(1)
    rows, want = [], {}
    for g, size in enumerate((60, 45, 7, 5, 4, 30)):
        n = rnd.normal(size=3)
        p = rnd.normal(0, 5, (size, 3))
        p -= np.outer(p @ n / (n @ n), n) * (1 if g < 5 else 0.98)
        p += rnd.normal(0, 0.02, (size, 3))
        p[:: 9] += rnd.normal(0, 3, 3)
        w = rnd.uniform(0.5, 2, size)
        rows += [(g, k, *map(float, q), float(x)) for k, (q, x) in enumerate(zip(p, w, strict=True))]
        active = np.arange(size)
        for _ in range(4):
            mid, m = plane(p[active], w[active])
            away = np.abs((p[active] - mid) @ m)
            if len(active) < 6:
                break
            active = active[away <= max(np.quantile(away, 0.8), 1e-9)]
        mid, m = plane(p[active], w[active])
        want[g] = mid, m, np.abs((p - mid) @ m), w, len(active)
    rows += [(8, 0, 1.0, 1.0, 1.0, 1.0), (8, 1, 2.0, 2.0, 2.0, 1.0), (9, 0, None, 1.0, 1.0, 1.0), (0, 900, float("nan"), 1.0, 1.0, 1.0), (0, 901, 1.0, 1.0, 1.0, 0.0)]
    got, each = planes.robust_fit(spark.createDataFrame(rows, "g long, id long, x double, y double, z double, w double"), ["g"], 0.8, 4)
    got, each = {r.g: r for r in got.collect()}, {(r.g, r.id): r.away for r in each.collect()}
    assert set(got) == set(want)
    for g, (mid, m, away, w, n) in want.items():
        r = got[g]
        assert r.n == n and np.allclose([r.cx, r.cy, r.cz], mid, atol=1e-6) and np.allclose([r.nx, r.ny, r.nz], m, atol=1e-5) and abs(r.d + m @ mid) < 1e-4
        assert np.allclose([each[g, k] for k in range(len(away))], away, atol=1e-5) and abs(r.rmse - math.sqrt((w * away**2).sum() / w.sum())) < 1e-5


def test_depth_planes_equal_numpy(spark):
    rnd = np.random.default_rng(2)
    rows, want = [], []
    for frame in range(2):
        own = []
        for u in range(40):
            for v in range(32):
                if rnd.random() < 0.9:
                    z = 2 + (0.02 * u if u < 16 else 0.32 - 0.05 * (u - 16) * frame) + (rnd.normal(0, 0.3) if v >= 24 and u >= 32 else rnd.normal(0, 1e-4))
                    own.append((frame, u, v, (u - 20) / 30 * z, (v - 16) / 30 * z, z))
        rows += own
        tiles = {}
        for r in own:
            tiles.setdefault((r[1] // 8, r[2] // 8), []).append(r[3:])
        merged, width = {}, 2 * math.sin(math.radians(10) / 2)
        for p in map(np.array, tiles.values()):
            if len(p) < 20:
                continue
            mid, n = plane(p, np.ones(len(p)))
            if np.median(np.abs((p - mid) @ n)) <= 0.01:
                merged.setdefault((*np.rint(n / width).astype(int), int(np.rint(-(n @ mid) / 0.1))), []).append(p)
        found = []
        for group in merged.values():
            p = np.concatenate(group)
            mid, n = plane(p, np.ones(len(p)))
            if len(p) >= 80 and np.median(np.abs((p - mid) @ n)) <= 0.1:
                found.append((len(p), *n, -(n @ mid), len(group)))
        want += [(frame, k, f) for k, f in enumerate(sorted(found, key=lambda f: (-f[0], *f[1:]))[:3])]
    got = planes.depth_plane_hypotheses(spark.createDataFrame([tuple(map(float, r)) for r in rows], "frame double, u double, v double, x double, y double, z double"), 8, 20, 0.01, 10.0, 0.1, 80, 3).collect()
    assert len(got) == len(want) >= 4 and max(f[5] for *_, f in want) > 1
    for r, (frame, k, f) in zip(sorted(got, key=lambda r: (r.frame, r.nth)), want, strict=True):
        assert (r.frame, r.nth, r.points, r.tiles) == (frame, k, f[0], f[5]) and np.allclose([r.nx, r.ny, r.nz, r.d], f[1:5], atol=1e-5)
