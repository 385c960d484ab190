"""Compositing in batches gives the image of one sort, whatever the batches."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import windows


def test_any_batches_give_the_same(spark):
    rnd = random.Random(1)
    rows = [(k % 7, k, rnd.choice([rnd.uniform(0, 1), 2.0]), rnd.choice([0.001, 0.3, rnd.uniform(0, 0.9), 1.0 if k % 7 == 3 else 0.5]), rnd.random(), rnd.random()) for k in range(600)]
    df = spark.createDataFrame(rows, "p long, id long, depth double, a0 double, red double, blue double")
    want = {r.p: r for r in windows.composite(df, ["p"], ["depth", "id"], "a0", "red").collect()}
    blue = {r.p: r.color for r in windows.composite(df, ["p"], ["depth", "id"], "a0", "blue").collect()}
    for width in (0.01, 0.3, 10.0):
        got = windows.composite_batches(df, ["p"], F.floor(F.col("depth") / width), ["depth", "id"], "a0", ["red", "blue"]).collect()
        assert len(got) == len(want) == 7
        for r in got:
            assert (r.red, r.blue, r.opacity) == pytest.approx((want[r.p].color, blue[r.p], want[r.p].opacity)) and r.used == want[r.p].used
    assert windows.composite_batches(df.limit(0), ["p"], F.col("depth"), ["id"], "a0", ["red"]).collect() == []
