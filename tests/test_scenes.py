import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import edits, mesh, planes, tracking, windows
from tessella.plans import catalog, scenes  # noqa: F401
from tessella.sources import meshes
from tessella.sources import scenes as files


def test_sparse_model_files(spark, tmp_path):
    pts = [(7, 1.0, 2.0, 3.0, 9, 8, 7, 0.5, [1, 2, 3]), (8, 0.0, 0.0, 1.0, 1, 2, 3, 2.5, [1, 2, 3]), (9, 0.0, 1.0, 0.0, 1, 2, 3, 1.0, [4])]
    out = struct.pack("<Q", len(pts))
    for *head, track in pts:
        out += struct.pack("<QdddBBBd", *head) + struct.pack("<Q", len(track)) + b"".join(struct.pack("<ii", i, 5) for i in track)
    (tmp_path / "points3D.bin").write_bytes(out)
    assert [tuple(r) for r in files.read_points(spark, str(tmp_path / "points3D.bin")).collect()] == [pts[0]]
    assert files.read_points(spark, str(tmp_path / "points3D.bin"), None, 0).count() == 3
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 2) + struct.pack("<iiQQ4d", 1, 1, 640, 480, 5.0, 5.0, 320.0, 240.0) + struct.pack("<iiQQ3d", 2, 0, 64, 48, 5.0, 32.0, 24.0))
    assert [(r.camera, r.model, len(r.params)) for r in files.read_cameras(spark, str(tmp_path / "cameras.bin")).collect()] == [(1, "PINHOLE", 4), (2, "SIMPLE_PINHOLE", 3)]
    one = lambda i, name, n: struct.pack("<idddddddi", i, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 1) + name + b"\0" + struct.pack("<Q", n) + bytes(24 * n)
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 2) + one(1, b"b.png", 2) + one(2, b"a.png", 0))
    assert [(r.image, r.name, r.n_points) for r in files.read_images(spark, str(tmp_path / "images.bin")).collect()] == [(2, "a.png", 0), (1, "b.png", 2)]


def test_sinks_and_lookups(spark, tmp_path):
    df = spark.createDataFrame([(k, float(k), k / 2, 0.0) for k in range(20)], "id long, x double, y double, z double").repartition(3)
    files.write_ply(df, str(tmp_path / "ply"), "id", ["x", "y", "z"])
    made = next((tmp_path / "ply").glob("part-*.txt"))
    assert made.read_text().splitlines()[:3] == ["ply", "format ascii 1.0", "element vertex 20"]
    made.rename(tmp_path / "a.ply")
    assert meshes.read_ply(spark, str(tmp_path / "a.ply"))[0].count() == 20
    files.write_frames(df.withColumn("frame", F.col("id") % 3), str(tmp_path / "frames"))
    assert sorted(p.name for p in (tmp_path / "frames").glob("frame=*")) == ["frame=0", "frame=1", "frame=2"]
    files.write_json(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "json"))
    assert next((tmp_path / "json").glob("part-*.json")).read_text() == '{"a":1,"b":"x"}\n'
    (tmp_path / "p.json").write_text('{"proxies": [{"id": 1, "d": 0.5}, {"id": 2, "d": 1.5}]}')
    assert [tuple(r) for r in files.read_planes(spark, str(tmp_path / "p.json"), "id: int, d: double").collect()] == [(1, 0.5), (2, 1.5)]
    there = spark.createDataFrame([("b/m",), ("c/m",)], "path string")
    got = files.first_existing(spark.createDataFrame([("m",), ("n",)], "name string"), there, "name", [F.concat(F.lit(d), F.col("name")) for d in ("a/", "b/", "c/")]).collect()
    assert sorted(map(tuple, got)) == [("m", "b/m"), ("n", None)]
    images, scans = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "name string, scan int, frame int")
    guides = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "scan int, frame int, path string")
    assert sorted(r.path for r in files.guide_paths(images, scans, guides).collect()) == ["x", "y"]
    with pytest.raises(ValueError):
        files.guide_paths(images, scans, guides.filter("frame = 1"))
    assert sorted(r.id for r in files.merge_tables([df.limit(2).select("id"), df.limit(0).select("id")], "id").collect())


def test_closest_points_equal_dense_search(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, rng.normal(size=12) * 3)) for _ in range(60)]
    names = [f"{n}{c}" for n in "pabc" for c in "xyz"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    at = lambda n: [F.col(f"{n}{c}") for c in "xyz"]
    got = [r[0] for r in df.select(V.distance_to_triangle(at("p"), at("a"), at("b"), at("c"))).collect()]
    g = np.linspace(0, 1, 200)
    u, v = np.meshgrid(g, g)
    ok = u + v <= 1
    u, v = u[ok][:, None], v[ok][:, None]
    for row, d in zip(rows, got, strict=True):
        p, a, b, c = np.array(row).reshape(4, 3)
        near = np.linalg.norm(a + u * (b - a) + v * (c - a) - p, axis=1).min()
        assert d <= near + 1e-9 and near - d < 0.05


def test_dominant_directions_equal_eigenvectors(spark):
    rng = np.random.default_rng(4)
    mats = [(lambda m: m @ m.T)(rng.normal(size=(3, 3))) for _ in range(30)]
    rows = [tuple(float(m[i, j]) for i in range(3) for j in range(i, 3)) for m in mats]
    got = planes.dominant_direction(spark.createDataFrame(rows, "xx double, xy double, xz double, yy double, yz double, zz double")).collect()
    for r in got:
        m = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
        value, vectors = np.linalg.eigh(m)
        assert r.top == pytest.approx(value[-1]) and abs(np.dot(vectors[:, -1], (r.vx, r.vy, r.vz))) == pytest.approx(1)


def test_tracks_equal_a_greedy_scan(spark):
    rng = np.random.default_rng(6)
    rows = [(int(a), int(b), float(v)) for (a, b), v in {(int(x), int(y)): v for x, y, v in zip(rng.integers(1, 9, 40), rng.integers(0, 9, 40), rng.uniform(0, 1, 40), strict=True)}.items()]
    used, want = set(), {}
    for a, b, v in sorted(rows, key=lambda r: -r[2]):
        if v >= 0.3 and ("a", a) not in used and b not in want:
            used.add(("a", a))
            want[b] = a
    new = [b for b in range(9) if b not in want]
    want |= {b: 100 + k for k, b in enumerate(new)}
    got = tracking.assign_tracks(spark.createDataFrame(rows, "was long, now long, iou double"), spark.range(9).withColumnRenamed("id", "now"), 0.3, 100)
    assert {r.now: r.track for r in got.collect()} == want


def test_draws_follow_the_weights(spark):
    live = spark.createDataFrame([(k, float(k)) for k in range(5)], "id long, w double")
    got = edits.draw(live, "id", "w", spark.range(20000).withColumnRenamed("id", "d"), "d", 1).groupBy("id").count().collect()
    assert {r.id for r in got} == {1, 2, 3, 4} and all(abs(r["count"] / 20000 - r.id / 10) < 0.02 for r in got)


def test_cell_size_meets_the_count(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([tuple(map(float, p)) for p in rng.uniform(0, 10, (2000, 2))], "x double, y double")
    size = tracking.cell_size(df, ["x", "y"], 100, 0.05, 10.0, 12)
    assert 80 <= df.select(F.floor(F.col("x") / size), F.floor(F.col("y") / size)).distinct().count() <= 125


def test_fans_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    tris = [(10 * k + 7, *rng.sample(range(12), 3)) for k in range(25)] + [(900, 20, 21, 22), (901, 20, 23, 24), (902, 20, 24, 25), (903, 20, 24, 26)]
    faces = spark.createDataFrame(tris, "f long, p long, q long, s long")
    want = {}
    for v in {v for _, *c in tris for v in c}:
        left = {f: set(c) - {v} for f, *c in tris if v in c}
        while left:
            fan = {min(left)}
            while more := {f for f, c in left.items() if f not in fan and any(c & left[g] for g in fan)}:
                fan |= more
            for f in fan:
                want[v, f] = min(fan)
            left = {f: c for f, c in left.items() if f not in fan}
    assert {(r.vertex, r.f): r.fan for r in mesh.fans(faces, "f", ["p", "q", "s"]).collect()} == want
    split, made = mesh.split_fans(faces, "f", ["p", "q", "s"], 100)
    again = [r.fan for r in mesh.fans(split, "f", ["p", "q", "s"]).groupBy("vertex").agg({"fan": "min"}).withColumnRenamed("min(fan)", "fan").collect()]
    extra = sorted({(v, fan) for (v, _), fan in want.items() if fan != min(g for (w, _), g in want.items() if w == v)})
    assert sorted((r.vertex, r.source) for r in made.collect()) == [(100 + k, v) for k, (v, _) in enumerate(extra)]
    assert len(again) == len({(v, fan) for (v, _), fan in want.items()})  # every vertex has one fan now
    assert mesh.fans(split, "f", ["p", "q", "s"]).select("vertex", "fan").distinct().count() == len(again)
    own = {r.f: (r.p, r.q, r.s) for r in split.collect()}
    assert own[900] == (20, 21, 22) and own[901][1:] == (23, 24) and own[901][0] == own[902][0] == own[903][0] == 100 + extra.index((20, 901))


def test_numbers_do_not_depend_on_ranges(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1009 k", "id % 5 w")
    want, at = {}, 0
    for n, (k, w) in enumerate(sorted((r.k, r.w) for r in rows.collect())):
        want[k] = (n, at)
        at += w
    for parts in ("1", "3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        n, s = windows.numbered(rows, ["k"], "n"), windows.numbered(rows, ["k"], "s", "w")
        assert {r.k: (r.n, r.s) for r in n.join(s, "k").collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert windows.numbered(rows.limit(0), ["k"], "n").count() == 0
