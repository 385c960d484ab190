import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import clusters, graph, planes


def test_greedy_matching_equals_a_scan_by_rank(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(r), int(a), int(b)) for r, a, b in zip(rng.integers(0, 40, 150), rng.integers(0, 30, 150), rng.integers(0, 30, 150), strict=True)})
    used, want = set(), []
    for rank, a, b in edges:
        if a != b and a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, rank))
    df = spark.createDataFrame([(a, b, k) for k, a, b in edges], "a long, b long, rank long")
    assert sorted(map(tuple, graph.greedy_matching(df).collect())) == sorted(want)
    assert graph.greedy_matching(df.limit(0)).count() == 0


def test_components_merge_by_mean_score(spark):
    rows = [(1, 2, 0.9, 2.0), (2, 3, 0.7, 1.0), (1, 3, 0.5, 1.0), (3, 4, 0.9, 0.2)]
    df = spark.createDataFrame(rows, "a long, b long, score double, confidence double")
    got = {t: dict(map(tuple, clusters.merge_components(df, t, 0.5).collect())) for t in ((0.9,), (0.9, 0.6), (0.9, 0.61))}
    assert got[(0.9,)] == {1: 1, 2: 1, 3: 3, 4: 4}
    assert got[(0.9, 0.6)] == {1: 1, 2: 1, 3: 1, 4: 4}  # the mean of 0.7 and 0.5
    assert got[(0.9, 0.61)] == got[(0.9,)]


def test_planes_equal_principal_axes(spark):
    rng = np.random.default_rng(5)
    rows = [(g, *map(float, p), float(w)) for g in range(4) for p, w in zip(rng.normal(size=(40, 3)) * [3, 2, 0.1 * g] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + g, rng.uniform(0.5, 2, 40), strict=True)]
    rows += [(9, float(k), float(k), 0.0, 1.0) for k in range(5)]
    for f in planes.fit(spark.createDataFrame(rows, "g long, x double, y double, z double, w double"), ["g"], "w").collect():
        p, w = np.array([r[1:4] for r in rows if r[0] == f.g]), np.array([r[4] for r in rows if r[0] == f.g])
        at = p - np.average(p, axis=0, weights=w)
        value, axes = np.linalg.eigh((at * w[:, None]).T @ at / w.sum())
        assert f.variance == pytest.approx(value[0], abs=1e-7)
        if f.g == 9:
            assert f.nx is None
        else:
            assert abs(np.dot((f.nx, f.ny, f.nz), axes[:, 0])) == pytest.approx(1, abs=1e-5)


def test_empty_points(spark):
    e = spark.createDataFrame([], "id long, x double, w double")
    assert clusters.k_means(e, "id", ["x"], 3, 2)[0].count() == 0
    assert clusters.two_gaussians(e, "x", "w", 3) is None


def test_components_of_a_long_path(spark):
    """Each round shortens a path by jumps, and the plan doesn't grow with the rounds."""
    n = 5000
    e = spark.range(n - 1).select(((F.col("id") * 7919) % n).alias("a"), (((F.col("id") + 1) * 7919) % n).alias("b"))
    got = graph.components(e)
    assert got.groupBy("root").count().collect() == [(0, n)]
    assert len(got._jdf.queryExecution().optimizedPlan().stats().simpleString()) < 40
