import numpy as np
import pytest

from tessella.plans import configs
from tessella.sources import meshes
from tessella.streaming import state

POINTS = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.5), (0.0, 2.0, 0.0), (1.0, 2.0, -1.0)]
HEAD = "ply\nformat {} 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"


def check(vertices, faces):
    assert sorted((v.vertex_id, v.x, v.y, v.z) for v in vertices.collect()) == [(k, *p) for k, p in enumerate(POINTS)]
    assert sorted((f.face_id, tuple(f.corners)) for f in faces.collect()) == [(0, (0, 1, 2)), (1, (1, 3, 2))]


def test_obj(spark, tmp_path):
    lines = [f"v {x} {y} {z}" for x, y, z in POINTS]
    (tmp_path / "a.obj").write_text("\n".join(["# mesh", *lines[:3], "f 1/1 2/2 3/3", lines[3], "f -3 -1 -2", ""]))
    check(*meshes.read_obj(spark, f"file://{tmp_path}/a.obj"))


@pytest.mark.parametrize("order", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(spark, tmp_path, order):
    if order == "ascii":
        body = "".join(f"{x} {y} {z}\n" for x, y, z in POINTS).encode() + b"3 0 1 2\n3 1 3 2\n"
    else:
        s = "<" if "little" in order else ">"
        body = np.array(POINTS, s + "f4").tobytes() + b"".join(b"\x03" + np.array(f, s + "i4").tobytes() for f in ((0, 1, 2), (1, 3, 2)))
    (tmp_path / "a.ply").write_bytes(HEAD.format(order).encode() + body)
    check(*meshes.read_ply(spark, f"file://{tmp_path}/a.ply"))


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "a.npz", means=np.arange(6.0).reshape(2, 3), label=np.array([4, 5]))
    got = meshes.read_npz(spark, f"file://{tmp_path}/a.npz", {"means": "array<double>", "label": "long"}).orderBy("row").collect()
    assert [(r.row, r.means, r.label) for r in got] == [(0, [0.0, 1.0, 2.0], 4), (1, [3.0, 4.0, 5.0], 5)]
    with pytest.raises(Exception, match="missing arrays: scales"):
        meshes.read_npz(spark, f"file://{tmp_path}/a.npz", {"scales": "double"}).collect()


def test_running_state_of_a_stream(spark, tmp_path):
    for k, rows in enumerate([[("a", 1.0), ("b", 5.0)], [("a", 3.0), (None, 2.0)]]):
        spark.createDataFrame(rows, "user string, x double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("user string, x double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = state.running(stream, ["user"], ["x"], ["x"]).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("running").collect()), key=str) == sorted([("a", 2, 4.0, 3.0), ("b", 1, 5.0, 5.0), (None, 1, 2.0, 2.0)], key=str)


def test_configurations(tmp_path):
    (tmp_path / "a.json").write_text('{"args": {"x": 1, "y": [1, 2]}, "kind": "run"}')
    (tmp_path / "b.json").write_text('{"extends": "a.json", "args": {"y": [3]}}')
    assert configs.load(tmp_path / "b.json") == {"kind": "run", "args": {"x": 1, "y": [3]}}
    (tmp_path / "c.json").write_text('{"extends": "c.json"}')
    with pytest.raises(ValueError, match="circle"):
        configs.load(tmp_path / "c.json")
