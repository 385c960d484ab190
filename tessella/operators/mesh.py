"""Triangle meshes: faces (face, three corner ids) over vertices (vertex, x, y, z). Corners are fetched by one join on
the vertex of an exploded corner and one regrouping by face, however many columns come along."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as V

from . import joins
from .edits import draw
from .graph import components
from .selection import uniform
from .windows import numbered


def with_corners(faces: DataFrame, vertices: DataFrame, face: str, corners: list[str], vertex: str, columns: list[str]) -> DataFrame:
    """faces with structs a, b, c of the corners' columns; faces with a corner that does not exist are left out."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(c).alias("_v")) for k, c in enumerate(corners)]))
    own = vertices.select(F.col(vertex).alias("_v"), F.struct(*columns).alias("_p"))
    got = faces.select(face, *corners, at.alias("_c")).select(face, *corners, "_c._k", "_c._v").join(own, "_v")
    x = got.groupBy(face, *corners).agg(*[F.max(F.when(F.col("_k") == k, F.col("_p"))).alias(n) for k, n in enumerate("abc")])
    return x.filter(" and ".join(f"{n} is not null" for n in "abc"))


def _doubled(a: str = "a", b: str = "b", c: str = "c") -> V.Vector:
    return V.cross(V.sub(V.of(b), V.of(a)), V.sub(V.of(c), V.of(a)))


def edge_lengths() -> V.Vector:
    a, b, c = V.of("a"), V.of("b"), V.of("c")
    return [V.norm(V.sub(b, a)), V.norm(V.sub(c, b)), V.norm(V.sub(a, c))]


def area() -> Column:
    return 0.5 * V.norm(_doubled())


def geometry(corners: DataFrame) -> DataFrame:
    """with_corners() with centre (cx, cy, cz), unit normal (nx, ny, nz), area and mean_edge."""
    n, e = _doubled(), edge_lengths()
    size = V.norm(n)
    x = corners
    for k, c in enumerate("xyz"):
        x = x.withColumn(f"c{c}", (F.col(f"a.{c}") + F.col(f"b.{c}") + F.col(f"c.{c}")) / 3).withColumn(f"n{c}", n[k] / F.greatest(size, F.lit(1e-12)))
    return x.withColumn("area", 0.5 * size).withColumn("mean_edge", (e[0] + e[1] + e[2]) / 3)


def quality() -> Column:
    """1 for an equilateral triangle, 0 for a flat one."""
    e = edge_lengths()
    return 4 * math.sqrt(3) * area() / F.greatest(e[0] * e[0] + e[1] * e[1] + e[2] * e[2], F.lit(1e-18))


def face_mean(faces: DataFrame, values: DataFrame, face: str, corners: list[str], vertex: str, x: str) -> DataFrame:
    """(face, mean) of a value over a face's corners."""
    each = faces.select(face, F.explode(F.array(*corners)).alias("_v"))
    return each.join(values.select(F.col(vertex).alias("_v"), F.col(x).alias("_x")), "_v").groupBy(face).agg(F.avg("_x").alias("mean"))


def incidence(faces: DataFrame, face: str, corners: list[str]) -> DataFrame:
    """(vertex, faces, neighbours), both sorted and without repeats. A vertex's lists are as long as its fan."""
    c = F.array(*corners)
    each = faces.select(face, F.explode(c).alias("vertex"), c.alias("_c"))
    return each.groupBy("vertex").agg(F.array_sort(F.collect_set(face)).alias("faces"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_c")))).alias("_n")).select("vertex", "faces", F.array_remove("_n", F.col("vertex")).alias("neighbours"))


def face_status(corners: DataFrame, rules: list[tuple[str, Column]], eps: float = 0.0) -> DataFrame:
    """with_corners() with status: 'repeated' corners, 'flat' (twice the area up to 2 * eps), else the first rule that
    holds, else 'kept'."""
    k = corners.columns[1:4]
    twice = (F.col(k[0]) == F.col(k[1])) | (F.col(k[1]) == F.col(k[2])) | (F.col(k[0]) == F.col(k[2]))
    out = F.lit("kept")
    for name, c in reversed([("repeated", twice), ("flat", V.norm(_doubled()) <= 2 * eps), *rules]):
        out = F.when(c, F.lit(name)).otherwise(out)
    return corners.withColumn("status", out)


def removal_log(source: DataFrame, status: DataFrame, face: str) -> DataFrame:
    """Every face of the source with its status; 'missing' for those that lost a vertex before."""
    return source.select(face).join(status.select(face, "status"), face, "left").select(face, F.coalesce("status", F.lit("missing")).alias("status"))


def profile(faces: DataFrame, corners: DataFrame, face: str, names: list[str]) -> DataFrame:
    """One row: n_vertices, n_faces, n_edges, boundary_edges, shared_edges (by more than two faces), n_components, area,
    shortest and longest edge."""
    e = joins.edges(faces, names, face)
    of_edges = e.agg(F.count(F.lit(1)).alias("n_edges"), F.count(F.when(F.col("n_faces") == 1, 1)).alias("boundary_edges"), F.count(F.when(F.col("n_faces") > 2, 1)).alias("shared_edges"))
    root = components(e.select("a", "b")).agg(F.countDistinct("root").alias("n_components"), F.count(F.lit(1)).alias("n_vertices"))
    x = edge_lengths()
    of_faces = corners.agg(F.count(F.lit(1)).alias("n_faces"), F.sum(area()).alias("area"), F.min(F.least(*x)).alias("shortest"), F.max(F.greatest(*x)).alias("longest"))
    return of_edges.join(F.broadcast(root)).join(F.broadcast(of_faces))  # one row each


def _edge_normals(faces: DataFrame, shapes: DataFrame, face: str, names: list[str]) -> DataFrame:
    n = shapes.select(face, F.struct("nx", "ny", "nz").alias("n"))
    e = joins.edges(faces, names, face)
    e = e.join(n.select(F.col(face).alias("face_a"), F.col("n").alias("na")), "face_a").join(n.select(F.col(face).alias("face_b"), F.col("n").alias("nb")), "face_b", "left")
    cosine = F.col("na.nx") * F.col("nb.nx") + F.col("na.ny") * F.col("nb.ny") + F.col("na.nz") * F.col("nb.nz")
    return e.withColumn("cosine", cosine)


def normal_variation(faces: DataFrame, shapes: DataFrame, face: str, names: list[str], tau: float) -> DataFrame:
    """(a, b, turn, score): how far the normals of an edge's first and last face turn, as a share of a right angle, and
    1 - exp(-turn**2 / tau**2); an edge of one face has turn 0 and score 1."""
    x = _edge_normals(faces, shapes, face, names).withColumn("turn", F.coalesce(V.angle(F.col("cosine")), F.lit(0.0)))
    return x.select("a", "b", "turn", F.when(F.col("face_b").isNull(), 1.0).otherwise(1 - F.exp(-(F.col("turn") * F.col("turn")) / (tau * tau))).alias("score"))


def feature_quality(faces: DataFrame, shapes: DataFrame, face: str, names: list[str], crease: float, boundary: float, least: float, gamma: float) -> DataFrame:
    """(vertex, quality): least + (1 - least) * score ** gamma of the highest score among a vertex's edges: 0 up to the
    crease angle (radians), 1 from a right angle on, `boundary` at the rim, 1 where more than two faces meet."""
    x = _edge_normals(faces, shapes, face, names)
    turn = F.acos(F.greatest(F.least(F.col("cosine"), F.lit(1.0)), F.lit(-1.0)))
    hard = max(math.pi / 2, crease + 1e-3)
    score = F.when(F.col("n_faces") > 2, 1.0).when(F.col("n_faces") == 1, boundary).otherwise(F.greatest(F.least((turn - crease) / (hard - crease), F.lit(1.0)), F.lit(0.0)))
    each = x.select(F.explode(F.array("a", "b")).alias("vertex"), score.alias("s"))
    return each.groupBy("vertex").agg(F.max("s").alias("s")).select("vertex", (least + (1 - least) * F.pow("s", F.lit(gamma))).alias("quality"))


def cull_unseen(faces: DataFrame, seen: DataFrame, corners: list[str], vertex: str) -> DataFrame:
    """Faces of which every corner is in seen (vertex, frame) in some frame."""
    ok = seen.select(F.col(vertex).alias("_v")).distinct()
    out = faces
    for c in corners:
        out = out.join(ok.withColumnRenamed("_v", c), c, "left_semi")
    return out.select(*faces.columns)


def sizing(shapes: DataFrame, face: str, target: Column, turn: Column, error: float, low: float, high: float) -> DataFrame:
    """(face, h): edge length at which the normal error stays within `error` radians, target * error / turn where both
    are positive, else the mean edge; between low and high times the 0.1 and 0.9 quantiles of mean edges."""
    q = shapes.filter("mean_edge > 1e-8").agg(F.percentile("mean_edge", F.array(F.lit(0.1), F.lit(0.9))).alias("_q"))
    x = shapes.join(F.broadcast(q))  # one row
    lo = F.lit(low) * F.col("_q")[0]
    hi = F.greatest(lo * 1.01, F.lit(high) * F.col("_q")[1])
    h = F.when((target > 1e-8) & (turn > 1e-8), target * error / turn).otherwise(F.col("mean_edge"))
    return x.select(face, F.greatest(F.least(h, hi), lo).alias("h"), "area")


def collapse_gates(faces: DataFrame, pairs: DataFrame, names: list[str], face: str) -> DataFrame:
    """(a, b, opposite, common, link_ok) of edges (a, b) to collapse: the corners opposite to the edge in its faces, the
    vertices next to both ends, and whether these are the same, which keeps a surface a surface."""
    near = incidence(faces, face, names).select("vertex", "neighbours")
    half = [F.struct(F.least(names[k], names[(k + 1) % 3]).alias("a"), F.greatest(names[k], names[(k + 1) % 3]).alias("b"), F.col(names[(k + 2) % 3]).alias("o")) for k in range(3)]
    opposite = faces.select(F.explode(F.array(*half)).alias("e")).select("e.*").groupBy("a", "b").agg(F.array_sort(F.collect_set("o")).alias("opposite"))
    x = pairs.select("a", "b").join(opposite, ["a", "b"]).join(near.select(F.col("vertex").alias("a"), F.col("neighbours").alias("na")), "a").join(near.select(F.col("vertex").alias("b"), F.col("neighbours").alias("nb")), "b")
    return x.select("a", "b", "opposite", F.array_sort(F.array_intersect("na", "nb")).alias("common")).withColumn("link_ok", F.col("opposite") == F.col("common"))


def fans(faces: DataFrame, face: str, corners: list[str]) -> DataFrame:
    """(vertex, face, fan): a vertex's faces that hang together by edges at it are a fan, named by its smallest face. Every
    face is linked with the smallest one on its edge, so that an edge of many faces makes no pairs."""
    c = F.array_distinct(F.array(*corners))
    side = faces.select(F.col(face).alias("face"), F.explode(c).alias("vertex"), c.alias("_c")).select("face", "vertex", F.explode("_c").alias("_o")).filter("_o <> vertex")
    hub = side.groupBy("vertex", "_o").agg(F.min("face").alias("_hub"))
    links = side.join(hub, ["vertex", "_o"]).select(F.struct("vertex", "face").alias("a"), F.struct("vertex", F.col("_hub").alias("face")).alias("b"))
    return components(links).select("node.vertex", F.col("node.face").alias(face), F.col("root.face").alias("fan"))


def split_fans(faces: DataFrame, face: str, corners: list[str], next_id: int) -> tuple[DataFrame, DataFrame]:
    """The faces with a vertex of its own for every fan but a vertex's first, and the new vertices (vertex, source),
    numbered from next_id in the order of their sources and fans."""
    f = fans(faces, face, corners)
    first = f.groupBy("vertex").agg(F.min("fan").alias("_first"))
    more = f.select("vertex", "fan").distinct().join(first, "vertex").filter("fan <> _first").select("vertex", "fan")
    made = numbered(more, ["vertex", "fan"], "_new").withColumn("_new", F.col("_new") + next_id)
    moves = f.join(made, ["vertex", "fan"]).groupBy(face).agg(F.map_from_entries(F.collect_list(F.struct("vertex", "_new"))).alias("_moves"))  # a face has three corners
    out = faces.join(moves, face, "left")
    for c in corners:
        out = out.withColumn(c, F.coalesce(F.col("_moves")[F.col(c)], F.col(c)))
    return out.select(*faces.columns), made.select(F.col("_new").alias("vertex"), F.col("vertex").alias("source"))


def surface_samples(corners: DataFrame, face: str, n: int, seed: int) -> DataFrame:
    """(sample, face, x, y, z): n places on with_corners(), drawn with replacement in proportion to the faces' areas, and
    evenly inside a face; faces of next to no area are never drawn."""
    x = corners.withColumn("_area", area()).filter("_area > 1e-12")
    hit = draw(x, face, "_area", corners.sparkSession.range(n).withColumnRenamed("id", "sample"), "sample", seed)
    got = hit.join(x, face).withColumn("_r", F.sqrt(uniform("sample", seed + 1))).withColumn("_s", uniform("sample", seed + 2))
    a, b, c = 1 - F.col("_r"), F.col("_r") * (1 - F.col("_s")), F.col("_r") * F.col("_s")
    return got.select("sample", face, *[(a * F.col(f"a.{k}") + b * F.col(f"b.{k}") + c * F.col(f"c.{k}")).alias(k) for k in "xyz"])
