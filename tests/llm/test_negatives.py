"""Hard negatives against SQL and against a scan of all pairs."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import negatives, queries, sql


def scan(rows, anchors):
    """Every anchor against every row; rows: (vec_id, label, vector)."""
    named = {}
    for r in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1], r[2])):
        named.setdefault(r[0], r)
    out = []
    for a, label, v in named.values():
        if a not in anchors:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=False)), b, m == label) for b, m, w in named.values() if b != a]
        for s, b, _ in sorted(x for x in scores if x[2])[:5]:
            fits = sorted(x for x in scores if not x[2] and -80 * s <= -100 * x[0] <= -100 * s)[:5]
            out += [(a, b, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, anchors, **more):
    df = spark.createDataFrame([(*r, r[0] in anchors, "x") for r in rows], "vec_id long, label long, vector array<long>, anchor boolean, score string")
    return sorted(map(tuple, negatives.mine(df, **more).collect()))


def vectors(seed, n, width, near):
    rnd = np.random.default_rng(seed)
    centres = rnd.integers(-60, 60, (4, width))
    return [(int(i), int(rnd.integers(0, 5)), (centres[rnd.integers(0, 4)] + rnd.integers(-near, near + 1, width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed, width, near", [(1, 1, 5), (2, 7, 0), (3, 16, 3), (4, 33, 40)])
def test_equals_a_scan(spark, seed, width, near):
    rows = vectors(seed, 240, width, near)
    anchors = set(range(0, 240, 9))
    assert mined(spark, rows, anchors) == scan(rows, anchors)
    assert mined(spark, rows, anchors, cells=20 * width) == scan(rows, anchors)  # more and smaller blocks


def test_odd_rows(spark):
    rows = vectors(5, 120, 6, 4)
    rows += [(None, 1, [1] * 6), (200, None, [1] * 6), (201, 1, None), (202, 1, []), (203, 2, [9]), (0, 3, [50] * 6), (0, 3, [50] * 6), (7, 1, [1, 2, 3, 4, 5, 6])]
    rows += [(300 + k, 0, [30, -30, 20, 10, 0, 1]) for k in range(150)] + [(500 + k, 1, [30, -30, 20, 10, 0, 1]) for k in range(40)]
    anchors = {0, 7, 14, 202, 203, 300, 333, 510}
    found = mined(spark, rows, anchors)
    assert found == scan(rows, anchors) and any(r[0] == 333 for r in found)
    assert mined(spark, [], set()) == [] and mined(spark, rows[:1], {0}) == [] and mined(spark, rows, set()) == []


def test_any_turn_gives_the_same(spark, monkeypatch):
    rows = vectors(6, 150, 12, 6)
    monkeypatch.setattr(negatives, "rotation", lambda rows, width: np.linalg.qr(np.random.default_rng(0).normal(size=(width, width)))[0])
    assert mined(spark, rows, {0, 50, 100}) == scan(rows, {0, 50, 100})


def test_bounds_hold_and_discard(spark):
    rnd = np.random.default_rng(8)
    v = rnd.integers(-9, 10, (2000, 4)) @ rnd.integers(-9, 10, (4, 32)) + rnd.integers(-2, 3, (2000, 32))
    turn = np.linalg.eigh(v.T @ v)[1][:, ::-1]
    block = negatives.Turned(np.arange(2000), np.zeros(2000, np.int64), v, turn, [4, 8, 16])
    a = negatives.Turned(np.arange(20), np.zeros(20, np.int64), v[:20], turn, [4, 8, 16])
    exact = v[:20] @ v.T
    reach = np.sort(exact, axis=1)[:, -10].astype(float)
    seen = []
    i, j, score = negatives.Search(turn, [4, 8, 16]).pairs(a, np.arange(20), block, 0, 2000, reach, np.full(20, np.inf), lambda a, own, b, lo, hi: np.ones((len(own), hi - lo), bool) if not seen.append(1) else None)
    assert set(zip(*np.nonzero(exact >= reach[:, None]), strict=True)) <= set(zip(i, j, strict=True)) and (score == exact[i, j]).all()
    assert len(i) < 2000  # of 40,000


def test_large_components_fail(spark):
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, 1, [1 << 40]), (1, 1, [1 << 40])], {0})


def test_query_equals_sql(spark, tmp_path):
    rnd = random.Random(4)
    base = [[rnd.uniform(-1, 1) for _ in range(8)] for _ in range(30)]
    rows = [(k, [x + rnd.uniform(-0.1, 0.1) for x in base[k % 30]], rnd.choice([*range(10), None]), 1.0) for k in range(500)]
    nan, inf = float("nan"), float("inf")
    rows += [(700, None, 3, 1.0), (701, [nan] * 8, 3, 1.0), (800, [inf] * 8, 3, 1.0), (900, [None] * 8, 3, 1.0), (1000, base[0], 4, 1.0), (1001, base[0], 4, 1.0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank double").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_hard_negatives(spark, str(tmp_path))
    for made, place in ((got, f"{tmp_path}/embeddings.parquet/*.parquet"), (queries.op12_hard_negatives(spark, "/root/testdata/sf0.001"), "/root/testdata/sf0.001/embeddings.parquet")):
        rel = duckdb.sql(f"WITH embeddings AS (SELECT * FROM '{place}') {sql.negatives().strip().replace('WITH r AS', ', r AS', 1)}")
        assert rel.columns == made.columns and sorted(map(tuple, made.collect())) == sorted(rel.fetchall())
    assert got.count() and dict(got.dtypes)["rank"] == "int"
    assert got.filter(F.col("anchor_id") == 1000).count()
