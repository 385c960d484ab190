import pytest
from pyspark.sql import functions as F

from tessella.operators import graph, windows
from tessella.sources import tables


def test_jsonl_round_trip_and_failure(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    tables.write_jsonl(df, f"file://{tmp_path}/j")
    assert sorted(map(tuple, tables.read_jsonl(spark, f"file://{tmp_path}/j", "k long, v string").collect())) == [(1, "a"), (2, None)]
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(Exception):
        tables.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", "k long").collect()


def test_required_and_latest_step(spark):
    df = spark.createDataFrame([("mesh_9.ply",), ("mesh_10.ply",), ("mesh.ply",)], "path string")
    assert tables.latest_step(df).first().path == "mesh_10.ply"
    with pytest.raises(ValueError, match="depth"):
        tables.required(df, ["path", "depth"])


def test_empty_tables(spark):
    e = spark.createDataFrame([], "a long, b long")
    assert graph.components(e).count() == 0
    assert windows.first_of(e, ["a"], "b").count() == 0


def test_nearest_takes_lowest_id_on_ties(spark):
    df = spark.createDataFrame([(1, 2.0, 7), (1, 2.0, 3), (1, 5.0, 1)], "pixel long, z double, id long")
    assert windows.nearest(df, ["pixel"], "z", "id").select(F.col("id")).first()[0] == 3
