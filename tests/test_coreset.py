"""Coresets against a serial scan, hulls against all triangles."""

import itertools

import numpy as np
import pytest

from tessella.operators import coreset

SCHEMA = "g long, id long, x double, y double"


def corners(pts):
    """Points that lie in no triangle or on no side of the others; of equal ones the first."""
    first = {}
    for k, p in enumerate(pts):
        first.setdefault(tuple(p), k)
    own = list(first)
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    out = set()
    for p in own:
        rest = [q for q in own if q != p]
        inside = any(turn(a, b, p) == 0 and (a[0] - p[0]) * (b[0] - p[0]) + (a[1] - p[1]) * (b[1] - p[1]) <= 0 for a, b in itertools.combinations(rest, 2))
        inside |= any(len({np.sign(turn(*t)) for t in ((a, b, p), (b, c, p), (c, a, p))}) == 1 and turn(a, b, c) != 0 for a, b, c in itertools.combinations(rest, 3))
        if not inside:
            out.add(first[p])
    return out


def scan(pts, count, alpha):
    pts = np.array(pts, float)
    ids = np.arange(len(pts))
    if len(pts) <= count:
        return list(ids)
    rest = np.array(sorted(set(ids) - corners(pts)))
    if len(pts) > 3 and len(rest) >= count:
        pts, ids = pts[rest], rest
    away = np.linalg.norm(pts - pts.mean(0), axis=1)
    picked = [int(np.argmin(away))]
    while len(picked) < count:
        score = np.min([np.linalg.norm(pts - pts[k], axis=1) for k in picked], axis=0) - alpha * away
        score[picked] = -np.inf
        picked.append(int(np.argmax(score)))
    return [int(ids[k]) for k in picked]


@pytest.mark.parametrize("count, alpha", [(5, 0.3), (9, 0.0)])
def test_picks_equal_a_scan(spark, count, alpha):
    rnd = np.random.default_rng(2)
    groups = [rnd.normal(0, 5, (24, 2)), rnd.integers(0, 4, (18, 2)) + rnd.choice([0, 1e-7], (18, 2)), rnd.normal(0, 1, (count, 2)), rnd.normal(0, 1, (count + 2, 2)), [[k, 2.0 * k] for k in range(12)], [[1.0, 1.0]]]
    rows = [(g, k, float(x), float(y)) for g, pts in enumerate(groups) for k, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for r in sorted(coreset.greedy_coreset(df, "g", count, alpha).collect(), key=lambda r: (r.g, r.nth)):
        got.setdefault(r.g, []).append(r.id)
    for g, pts in enumerate(groups):
        want = scan(pts, count, alpha)
        assert got[g] == want, g


def test_hull_and_empty(spark):
    rnd = np.random.default_rng(3)
    pts = rnd.integers(0, 6, (30, 2))
    df = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(pts)], SCHEMA).repartition(4)
    assert {r.id for r in coreset.hull(df, "g").collect()} == corners(pts.tolist())
    assert coreset.greedy_coreset(df.limit(0), "g", 3, 0.1).collect() == []
