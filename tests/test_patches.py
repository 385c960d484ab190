"""Planar patches against a scan by face id."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import joins, mesh, patches

SCHEMA = "face long, cx double, cy double, cz double, nx double, ny double, nz double, area double, planar double, eps double"


def terrain(seed, n):
    """A grid of two triangles a cell, flat terraces with steps and noise: (vertices, faces)."""
    rnd = random.Random(seed)
    steps = [rnd.choice([0.0, 0.0, 0.3, 1.0]) for _ in range(n // 3 + 2)]
    level = [sum(steps[: k // 3 + 1]) for k in range(n + 1)]
    v = [(i * (n + 1) + j, float(i), float(j), level[i] + (0.25 * j if j > n // 2 else 0.0) + rnd.uniform(-0.03, 0.03)) for i in range(n + 1) for j in range(n + 1)]
    f = []
    for i in range(n):
        for j in range(n):
            a = i * (n + 1) + j
            f += [(len(f), a, a + n + 1, a + 1), (len(f) + 1, a + n + 1, a + n + 2, a + 1)]
    rnd.shuffle(f)
    return v, [(k, *t[1:]) for k, t in enumerate(f)]


def scan(rows, links, degrees, distance):
    """The smallest face that is left takes all that it reaches over faces that fit its plane."""
    near = {r[0]: set() for r in rows}
    for a, b in links:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    at = {r[0]: r for r in rows}
    seed_of = {}
    for s in sorted(at):
        if s in seed_of:
            continue
        seed_of[s], todo = s, [s]
        n, c = np.array(at[s][4:7]), np.array(at[s][1:4])
        while todo:
            for f in near[todo.pop()] - seed_of.keys():
                m, q = np.array(at[f][4:7]), np.array(at[f][1:4])
                if m @ m > 0 and abs(n @ m) >= math.cos(math.radians(degrees)) and abs(n @ q - n @ c) <= distance * max(at[f][9], 1e-6):
                    seed_of[f] = s
                    todo.append(f)
    return seed_of


def plane(rows):
    c, w = np.array([r[1:4] for r in rows]), np.array([max(r[7] * r[8], 1e-8) for r in rows])
    mid = (c * w[:, None]).sum(0) / w.sum()
    n = np.linalg.eigh(((c - mid) * w[:, None]).T @ (c - mid))[1][:, 0]
    n = n if n @ (np.array([r[4:7] for r in rows]) * np.array([[r[7]] for r in rows])).sum(0) >= 0 else -n
    return n, -n @ mid


@pytest.fixture(scope="module", params=[(1, 9), (2, 12)])
def shaped(spark, request):
    v, f = terrain(*request.param)
    faces, verts = spark.createDataFrame(f, "f long, p long, q long, s long"), spark.createDataFrame(v, "v long, x double, y double, z double")
    g = mesh.geometry(mesh.with_corners(faces, verts, "f", ["p", "q", "s"], "v", ["x", "y", "z"]))
    g = g.select(F.col("f").alias("face"), "cx", "cy", "cz", "nx", "ny", "nz", "area", (F.col("f") % 10 / 10.0).alias("planar"), (0.25 * F.col("mean_edge")).alias("eps"))
    rows = sorted(map(tuple, g.collect()))
    links = [(r.face_a, r.face_b) for r in joins.edges(faces, ["p", "q", "s"], "f").filter("face_b is not null and (a + b) % 13 <> 0").collect()]
    return rows, links


@pytest.mark.parametrize("most, degrees, distance", [(10**6, 12.0, 0.5), (10**6, 40.0, 1.5), (60, 40.0, 1.5)])
def test_regions_equal_a_scan(spark, shaped, most, degrees, distance):
    rows, links = shaped
    if most == 60:  # a round for each of the first regions
        rows = rows[:130]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("plane", F.struct("nx", "ny", "nz", (-(F.col("nx") * F.col("cx") + F.col("ny") * F.col("cy") + F.col("nz") * F.col("cz"))).alias("d")))
    got = patches.grown(df, spark.createDataFrame(links, "a long, b long"), degrees, distance, most)
    assert {r.face: r.seed for r in got.collect()} == scan(rows, links, degrees, distance)


def test_patches_are_refitted_and_trimmed(spark, shaped):
    rows, links = shaped
    own, found = patches.planar_patches(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(links, "a long, b long"), 40.0, 1.5, 0.35, 5, 0.15)
    take = [r for r in rows if r[8] >= 0.15]
    regions = {}
    for f, s in scan(take, links, 40.0, 1.5).items():
        regions.setdefault(s, []).append(f)
    at, want = {r[0]: r for r in take}, []
    for s, members in sorted(regions.items()):
        if len(members) < 5:
            continue
        n, d = plane([at[f] for f in members])
        members = [f for f in members if abs(n @ at[f][4:7]) >= math.cos(math.radians(40)) and abs(n @ at[f][1:4] + d) <= 0.35 * at[f][9]]
        if len(members) >= 5:
            want.append((s, sorted(members), *plane([at[f] for f in members])))
    got = {r.patch: r for r in found.collect()}
    assert len(want) > 2 and sum(len(m) for _, m, _, _ in want) < sum(map(len, regions.values()))
    assert sorted((r.patch, r.face) for r in own.collect()) == [(k, f) for k, w in enumerate(want) for f in w[1]]
    for k, (s, members, n, d) in enumerate(want):
        r = got[k]
        assert (r.seed, r.n_faces) == (s, len(members)) and np.allclose([r.nx, r.ny, r.nz, r.d], [*n, d], atol=1e-6)
        assert r.area == pytest.approx(sum(at[f][7] for f in members)) and r.residual_max == pytest.approx(max(abs(n @ at[f][1:4] + d) for f in members), abs=1e-6)


def test_seeds_by_given_planes_and_empty(spark):
    rows = [(k, float(k), 0.0, 0.0, 0.0, 0.0, 1.0 if k else 0.0, 1.0, 1.0, 0.5) for k in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("plane", F.struct(F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), F.lit(0.0).alias("d")))
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 9)], "a long, b long")
    assert {(r.face, r.seed) for r in patches.grown(df, links, 10.0, 1.0).collect()} == {(k, 0) for k in range(4)}  # a face without a normal is a seed by its plane
    assert patches.grown(df.limit(0), links, 10.0, 1.0).collect() == []
