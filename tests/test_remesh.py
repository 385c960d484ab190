"""Collapse and flip passes against serial scans by rank over small meshes."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import joins, remesh

from .test_patches import terrain

FACES, VERTS = "face long, v0 long, v1 long, v2 long", "vertex long, x double, y double, z double"


def frames(spark, seed, n):
    v, f = terrain(seed, n)
    f += [(len(f), *f[0][1:]), (len(f) + 1, f[3][3], f[3][1], f[3][2])]  # repeated faces: edges of more than two
    return {i: np.array(p) for i, *p in v}, {k: t for k, *t in f}, spark.createDataFrame(v, VERTS), spark.createDataFrame(f, FACES)


def edges_of(faces):
    out = {}
    for k, t in sorted(faces.items()):
        for i in range(3):
            a, b = sorted((t[i], t[(i + 1) % 3]))
            if a != b:
                out.setdefault((a, b), []).append(k)
    return out


def normal(p, q, r):
    n = np.cross(q - p, r - p)
    return n / max(np.linalg.norm(n), 1e-12), np.linalg.norm(n)


def quality(p, q, r):
    e = sum(((a - b) ** 2).sum() for a, b in ((p, q), (q, r), (r, p)))
    return 2 * math.sqrt(3) * normal(p, q, r)[1] / max(e, 1e-18)


def place(at, faces, a, b):
    """The least error of both ends' quadrics, and where it is."""
    total = np.zeros((4, 4))
    for end in (a, b):
        for t in faces.values():
            if end in t:
                n, doubled = normal(*(at[v] for v in t))
                h = np.append(n, -n @ at[t[0]])
                total += 0.5 * doubled * np.outer(h, h)
    error = lambda p: max(0.0, np.append(p, 1) @ total @ np.append(p, 1))
    A = total[:3, :3]
    if abs(np.linalg.det(A)) > 1e-6 * (np.trace(A) / 3) ** 3:
        p = np.linalg.solve(A, -total[:3, 3])
        return p, error(p)
    p = min(((at[a] + at[b]) / 2, at[a], at[b]), key=lambda p: round(error(p), 12))
    return p, error(p)


def gates(at, faces, a, b, p, detail, tau, hard, soft):
    sound, turn, low, lacks = True, 0.0, None, 0.0
    for t in faces.values():
        if (a in t) == (b in t):
            continue
        old, _ = normal(*(at[v] for v in t))
        new = [p if v in (a, b) else at[v] for v in t]
        n, doubled = normal(*new)
        if doubled <= 1e-12:
            sound, low = False, low
            continue
        sound &= bool(n @ old > 0)
        turn, q = max(turn, 1 - min(1.0, n @ old)), quality(*new)
        low, lacks = q if low is None else min(low, q), lacks + max(0.0, soft - q) ** 2
    if low is None:
        return False, False, math.inf, math.inf, 0.0
    return sound, low >= hard, detail * turn / max(1 - math.cos(tau), 1e-9), lacks, low


@pytest.mark.parametrize("seed", [3, 4])
def test_collapse_pass_equals_a_scan(spark, seed):
    at, faces, v, f = frames(spark, seed, 6)
    new_f, new_v, log = remesh.collapse_pass(f, v, most_cost=0.01, soft=0.6, most_lack=0.12)
    log = sorted(log.collect(), key=lambda r: r["rank"])
    e = edges_of(faces)
    around = {}
    for t in faces.values():
        for x in t:
            around.setdefault(x, set()).update(y for y in t if y != x)
    assert {(r.a, r.b) for r in log} == set(e) and [r["rank"] for r in log] == list(range(len(log)))
    touched, moved, reasons = set(), {}, set()
    assert [r.cost for r in log] == sorted(r.cost for r in log)
    for r in log:
        p, cost = place(at, faces, r.a, r.b)
        assert r.cost == pytest.approx(cost, abs=1e-9)
        want = "boundary" if len(e[r.a, r.b]) != 2 else "cost" if r.cost > 0.01 else None
        if want is None:
            g = gates(at, faces, r.a, r.b, p, 1.0, 0.35, 0.05, 0.6)
            opposite = {x for k in e[r.a, r.b] for x in faces[k]} - {r.a, r.b}
            assert (r.topology_ok, r.link_ok) == (g[0], around[r.a] & around[r.b] == opposite)
            assert np.allclose([r.normal_error, r.quality_error, r.min_quality], g[2:], rtol=1e-6, atol=1e-6)
            if r.a in touched or r.b in touched:
                want = "batch_conflict"
            elif not (g[0] and r.link_ok):
                want = "topology"
            elif g[2] > 1:
                want = "normal"
            elif not g[1] or g[3] > 0.12:
                want = "quality"
            else:
                want = "accepted"
                touched |= {r.a, r.b}
                moved[r.b], at_new = r.a, (r.a, p)
                moved[("at", r.a)] = at_new[1]
        reasons.add(want)
        assert r.reason == want
    assert {"accepted", "boundary", "cost", "batch_conflict"} <= reasons and (seed == 4 or reasons & {"normal", "quality", "topology"})
    left = {}
    for k, t in sorted(faces.items()):
        t = [moved.get(x, x) for x in t]
        if len(set(t)) == 3:
            left.setdefault(tuple(sorted(t)), (k, t))
    ids = {x: k for k, x in enumerate(sorted({x for _, t in left.values() for x in t}))}
    assert sorted(map(tuple, new_f.collect())) == sorted((k, *[ids[x] for x in t]) for k, t in left.values())
    got = {r.vertex: (r.x, r.y, r.z) for r in new_v.collect()}
    assert set(got) == set(ids.values()) and all(np.allclose(got[k], moved.get(("at", x), at[x]), atol=1e-6) for x, k in ids.items())


@pytest.mark.parametrize("seed, most", [(5, None), (6, 4)])
def test_flip_pass_equals_a_scan(spark, seed, most):
    at, faces, v, f = frames(spark, seed, 7)
    score = joins.edges(f, remesh.CORNERS, "face").select("a", "b", (((F.col("a") * F.col("a") + F.col("b") * 3) % 10 - 1) / 10.0).alias("score"))
    new, flips = remesh.flip_pass(f, v, score, gain=-0.2, most=most)
    e, touched, took, now = edges_of(faces), set(), [], dict(faces)
    for a, b in sorted(e, key=lambda k: (-((k[0] * k[0] + k[1] * 3) % 10 - 1), k)):
        if (a * a + b * 3) % 10 - 1 <= 0 or len(e[a, b]) != 2 or (most is not None and len(took) >= most):
            continue
        fa, fb = e[a, b]
        (c,), (d,) = set(faces[fa]) - {a, b}, set(faces[fb]) - {a, b}
        if c == d or tuple(sorted((c, d))) in e or touched & {a, b, c, d}:
            continue
        old = min(quality(*(at[x] for x in faces[k])) for k in (fa, fb))
        turned = min(quality(*(at[x] for x in t)) for t in ((c, d, b), (d, c, a)))
        if turned - old >= -0.2 and min(normal(*(at[x] for x in t))[1] for t in ((c, d, b), (d, c, a))) > 1e-12:
            took.append((a, b, fa, fb, c, d))
            touched |= {a, b, c, d}
            now[fa], now[fb] = (c, d, b), (d, c, a)
    assert len(took) > 3
    assert sorted(tuple(r)[:6] for r in flips.collect()) == sorted(took)
    assert sorted(map(tuple, new.collect())) == sorted((k, *t) for k, t in now.items())


def test_independent_sets(spark):
    rows = [(k, k % 4, [(k * 5) % 11, (k * 3 + 1) % 11, 20 + k % 3]) for k in range(25)]
    used, want = set(), set()
    for item, _, nodes in sorted(rows, key=lambda r: (r[1], r[0])):
        if not used & set(nodes):
            used |= set(nodes)
            want.add(item)
    df = spark.createDataFrame([(i, r, sorted(set(n))) for i, r, n in rows], "item long, rank long, nodes array<long>")
    assert {r.item for r in remesh.independent(df).collect()} == want
    assert remesh.independent(df.limit(0)).collect() == []


def test_empty_pass(spark):
    _, _, v, f = frames(spark, 1, 2)
    f2, v2, log = remesh.collapse_pass(f.limit(0), v, most_cost=1.0)
    assert f2.collect() == [] and v2.collect() == [] and log.collect() == []
    assert list(itertools.chain(*(x.collect() for x in remesh.flip_pass(f.limit(0), v, spark.createDataFrame([], "a long, b long, score double"), 0.0)))) == []
