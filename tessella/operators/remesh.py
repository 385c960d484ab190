"""Edits of a triangle mesh that must not meet: edge collapses at error-quadric places and edge flips, each simulated on
the mesh as it is, then taken by rank as far as they don't touch, then applied at once. Faces are (face, v0, v1, v2),
vertices (vertex, x, y, z). An edge's simulation reads the faces around both its ends, so a vertex of n faces costs n
rows for each of its candidate edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.staging import reread, stage, unstage

from . import joins, mesh
from .graph import greedy_matching
from .windows import numbered

CORNERS = ["v0", "v1", "v2"]
AXES = ["x", "y", "z"]
#: Of the quadric p' A p + 2 b' p + c.
TERMS = ["a00", "a01", "a02", "a11", "a12", "a22", "b0", "b1", "b2", "c"]


def _shaped(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with corner structs a, b, c and their unit normal."""
    g = mesh.geometry(mesh.with_corners(faces, vertices, "face", CORNERS, "vertex", AXES))
    return g.select("face", *CORNERS, "a", "b", "c", "nx", "ny", "nz", "area")


def quadrics(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vertex, TERMS): the sum of the squared distances to the planes of a vertex's faces, weighted by area."""
    g = _shaped(faces, vertices)
    n = [F.col(f"n{a}") for a in AXES]
    d = -V.dot(n, V.of("a"))
    one = [n[0] * n[0], n[0] * n[1], n[0] * n[2], n[1] * n[1], n[1] * n[2], n[2] * n[2], n[0] * d, n[1] * d, n[2] * d, d * d]
    each = g.select(F.explode(F.array(*CORNERS)).alias("vertex"), *[(F.col("area") * x).alias(t) for x, t in zip(one, TERMS, strict=True)])
    return each.groupBy("vertex").agg(*[F.sum(t).alias(t) for t in TERMS])


def _error(p: V.Vector) -> Column:
    a00, a01, a02, a11, a12, a22, b0, b1, b2, c = (F.col(t) for t in TERMS)
    square = a00 * p[0] * p[0] + a11 * p[1] * p[1] + a22 * p[2] * p[2] + 2 * (a01 * p[0] * p[1] + a02 * p[0] * p[2] + a12 * p[1] * p[2])
    return F.greatest(square + 2 * (b0 * p[0] + b1 * p[1] + b2 * p[2]) + c, F.lit(0.0))


def collapse_places(pairs: DataFrame, quadric: DataFrame, vertices: DataFrame, well: float = 1e-6) -> DataFrame:
    """(a, b, x, y, z, cost) of edges (a, b): where the quadrics of both ends add up to the least error. Where the system
    is too flat to solve (its determinant under `well` times the cube of a third of its trace), the best of the middle
    and both ends, in this order."""
    own = vertices.select("vertex", F.struct(*AXES).alias("p")).join(quadric, "vertex")
    ends = [own.select(F.col("vertex").alias(k), F.col("p").alias(f"p{k}"), *[F.col(t).alias(f"{t}_{k}") for t in TERMS]) for k in "ab"]
    x = pairs.select("a", "b").join(ends[0], "a").join(ends[1], "b")
    x = x.select("a", "b", "pa", "pb", *[(F.col(f"{t}_a") + F.col(f"{t}_b")).alias(t) for t in TERMS])
    rows = [[F.col(t) for t in r] for r in (("a00", "a01", "a02"), ("a01", "a11", "a12"), ("a02", "a12", "a22"))]
    side = [-F.col(t) for t in ("b0", "b1", "b2")]
    x = x.withColumn("det", V.dot(rows[0], V.cross(rows[1], rows[2])))
    solved = [V.dot([rows[j][(k + 1) % 3] for j in range(3)], V.cross([rows[j][(k + 2) % 3] for j in range(3)], side)) / F.col("det") for k in range(3)]
    third = (F.col("a00") + F.col("a11") + F.col("a22")) / 3
    x = x.withColumn("best", F.when(F.abs("det") > well * third * third * third, F.struct(*[s.alias(a) for s, a in zip(solved, AXES, strict=True)])))
    middle = V.scale(V.add(V.of("pa"), V.of("pb")), F.lit(0.5))
    tried = [F.struct(_error(p).alias("cost"), F.lit(k).alias("k"), *[c.alias(a) for c, a in zip(p, AXES, strict=True)]) for k, p in enumerate((middle, V.of("pa"), V.of("pb")))]
    x = x.withColumn("least", F.least(*tried))
    place = [F.coalesce(F.col(f"best.{a}"), F.col(f"least.{a}")).alias(a) for a in AXES]
    return x.withColumn("e", F.when(F.col("best").isNull(), F.col("least.cost")).otherwise(_error(V.of("best")))).select("a", "b", *place, F.col("e").alias("cost"))


def _quality(a: V.Vector, b: V.Vector, c: V.Vector, doubled: Column) -> Column:
    e = [V.sub(b, a), V.sub(c, b), V.sub(a, c)]
    return 2 * math.sqrt(3) * doubled / F.greatest(sum((V.dot(x, x) for x in e), F.lit(0.0)), F.lit(1e-18))


def collapse_simulation(faces: DataFrame, vertices: DataFrame, moves: DataFrame, hard: float, soft: float) -> DataFrame:
    """(a, b, topology_ok, quality_ok, normal_error, quality_error, min_quality) of moves (a, b, x, y, z, detail, tau):
    what becomes of the faces around an edge when both its ends move to one place. Faces that hold both ends go;
    topology is fine if some are left, none of them loses its area or turns over; the normal error is the largest
    1 - cosine of a turn, by detail and against tau; quality must reach `hard`, its error sums squared lacks to `soft`.
    An edge around which no face is left has infinite errors."""
    around = _shaped(faces, vertices).withColumn("end", F.explode(F.array(*CORNERS)))
    end = F.explode(F.array(F.struct(F.col("a").alias("end"), F.col("b").alias("other")), F.struct(F.col("b").alias("end"), F.col("a").alias("other"))))
    move = moves.select(F.col("a").alias("from"), F.col("b").alias("to"), F.struct(*AXES).alias("place"), "detail", "tau", end.alias("e")).select("from", "to", "place", "detail", "tau", "e.end", "e.other")
    x = move.join(around, "end").filter(" and ".join(f"other <> {c}" for c in CORNERS))
    for n, c in zip("abc", CORNERS, strict=True):
        x = x.withColumn(n, F.when(F.col(c) == F.col("end"), F.col("place")).otherwise(F.col(n)))
    a, b, c = V.of("a"), V.of("b"), V.of("c")
    for k, n in enumerate(V.cross(V.sub(b, a), V.sub(c, a))):
        x = x.withColumn(f"m{k}", n)
    m = [F.col(f"m{k}") for k in range(3)]
    x = x.withColumn("doubled", V.norm(m)).withColumn("cosine", V.dot(m, [F.col(f"n{k}") for k in AXES]) / F.greatest("doubled", F.lit(1e-12)))
    x = x.withColumn("whole", F.col("doubled") > 1e-12).withColumn("quality", F.when(F.col("whole"), _quality(a, b, c, F.col("doubled"))))
    turn = F.when(F.col("whole"), F.greatest(1 - F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0)), F.lit(0.0)))
    lack = F.greatest(F.lit(soft) - F.col("quality"), F.lit(0.0))
    found = x.groupBy(F.col("from").alias("a"), F.col("to").alias("b")).agg(
        F.min(F.col("whole") & (F.col("cosine") > 0)).alias("sound"), F.max(turn).alias("turn"), F.min("quality").alias("low"), F.sum(F.when(F.col("whole"), lack * lack)).alias("lacks")
    )
    y = moves.select("a", "b", "detail", "tau").join(found, ["a", "b"], "left")
    least = F.greatest(1 - F.cos(F.greatest("tau", F.lit(1e-6))), F.lit(1e-9))
    none = F.col("low").isNull()
    return y.select(
        "a", "b", (~none & F.coalesce("sound", F.lit(False))).alias("topology_ok"), (~none & (F.col("low") >= hard)).alias("quality_ok"),
        F.when(none, float("inf")).otherwise(F.greatest("detail", F.lit(0.0)) * F.col("turn") / least).alias("normal_error"),
        F.when(none, float("inf")).otherwise(F.col("lacks")).alias("quality_error"), F.coalesce("low", F.lit(0.0)).alias("min_quality"),
    )


def collapse_decisions(edges: DataFrame) -> DataFrame:
    """edges (a, b, rank, early, late) with reason: a scan by rank takes an edge unless a rule rejects it or an edge that
    was taken before has one of its ends. `early` holds the reason of a rule that comes before the look at taken ends,
    `late` of one that comes after it; null where none rejects. What the rules say hangs on the mesh before the pass
    alone, so the taken ones are the greedy matching of all that no rule rejects."""
    e = stage(edges, "edges")
    taken = stage(greedy_matching(e.filter("early is null and late is null").select("a", "b", "rank")), "taken")
    at = taken.select(F.explode(F.array("a", "b")).alias("v"), F.col("rank").alias("by"))
    x = e.join(taken.select("a", "b", F.lit(True).alias("took")), ["a", "b"], "left")
    for c in "ab":
        x = x.join(at.select(F.col("v").alias(c), F.col("by").alias(f"by_{c}")), c, "left")
    met = F.least("by_a", "by_b") < F.col("rank")  # least passes over nulls
    reason = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("took"), "accepted").when(met, "batch_conflict").otherwise(F.col("late"))
    return x.withColumn("reason", reason).select(*edges.columns, "reason")


def collapse(faces: DataFrame, vertices: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces and vertices after edges taken (a, b, x, y, z) have become their lower end, at its new place: without faces
    that lost a corner and repeats of another face (the lowest stays), and vertices that no face holds; vertices are
    numbered anew in their order."""
    gone = taken.select(F.greatest("a", "b").alias("was"), F.least("a", "b").alias("now"))
    corner = faces.select("face", F.posexplode(F.array(*CORNERS)).alias("k", "was")).join(gone, "was", "left").select("face", "k", F.coalesce("now", "was").alias("v"))
    moved = corner.groupBy("face").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(c) for k, c in enumerate(CORNERS)])
    whole = moved.filter("v0 <> v1 and v1 <> v2 and v0 <> v2")
    left = stage(whole.groupBy(F.array_sort(F.array(*CORNERS)).alias("set")).agg(F.min(F.struct("face", *CORNERS)).alias("f")).select("f.*"), "faces")
    place = taken.select(F.least("a", "b").alias("vertex"), F.struct(*AXES).alias("place"))
    used = left.select(F.explode(F.array(*CORNERS)).alias("vertex")).distinct()
    kept = vertices.join(used, "vertex", "left_semi").join(place, "vertex", "left")
    kept = stage(numbered(kept.select("vertex", *[F.coalesce(F.col(f"place.{a}"), F.col(a)).alias(a) for a in AXES]), ["vertex"], "number"), "vertices")
    out = left
    for c in CORNERS:
        out = out.join(kept.select(F.col("vertex").alias(c), F.col("number").alias(f"new_{c}")), c)
    return out.select("face", *[F.col(f"new_{c}").alias(c) for c in CORNERS]), kept.select(F.col("number").alias("vertex"), *AXES)


def collapse_pass(faces: DataFrame, vertices: DataFrame, most_cost: float, detail: float = 1.0, tau: float = 0.35, hard: float = 0.05, soft: float = 0.35, most_normal: float = 1.0, most_lack: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass: faces, vertices and the log (a, b, rank, cost, gates, reason) of all edges, ranked by cost, a and b.
    Rim edges and ones of more than two faces are rejected as 'boundary', dear ones as 'cost', others by their gates:
    'topology' (also if the vertices next to both ends aren't the edge's opposite corners), 'normal', 'quality'."""
    e = joins.edges(faces, CORNERS, "face")
    places = stage(e.join(collapse_places(e, quadrics(faces, vertices), vertices), ["a", "b"]).select("a", "b", "n_faces", *AXES, "cost"), "places")
    early = F.when(F.col("n_faces") != 2, "boundary").when(F.col("cost") > most_cost, "cost")
    ranked = stage(numbered(places.withColumn("early", early), ["cost", "a", "b"], "rank"), "ranked")
    open_ = ranked.filter("early is null")
    gates = collapse_simulation(faces, vertices, open_.select("a", "b", *AXES, F.lit(detail).alias("detail"), F.lit(tau).alias("tau")), hard, soft)
    link = mesh.collapse_gates(faces, open_, CORNERS, "face").select("a", "b", "link_ok")
    late = F.when(~F.col("link_ok") | ~F.col("topology_ok"), "topology").when(F.col("normal_error") > most_normal, "normal").when(~F.col("quality_ok") | (F.col("quality_error") > most_lack), "quality")
    judged = ranked.join(gates, ["a", "b"], "left").join(link, ["a", "b"], "left").withColumn("late", F.when(F.col("early").isNull(), late))
    log = stage(collapse_decisions(judged), "log")
    unstage(places, ranked)
    after = collapse(faces, vertices, log.filter("reason = 'accepted'").select("a", "b", *AXES))
    return *after, log.select("a", "b", "rank", "cost", "topology_ok", "link_ok", "normal_error", "quality_error", "min_quality", "reason")


def independent(items: DataFrame) -> DataFrame:
    """items (item, rank, nodes) that a scan by rank and item would take, no two with a node in common. Rounds as in
    graph.greedy_matching: what comes first at all its nodes is taken, what shares a node with it goes."""
    key = F.struct("rank", "item")
    left, taken = stage(items.select("item", "nodes", key.alias("key")), "items"), []
    while left.limit(1).count():
        at = left.select(F.explode("nodes").alias("node"), "key", F.size("nodes").alias("of"))
        first = at.groupBy("node").agg(F.min(F.struct("key", "of")).alias("f"))
        now = stage(first.groupBy("f.key", "f.of").count().filter("count = of").select("key"), "taken")
        taken.append(now)
        used = left.join(now, "key", "left_semi").select(F.explode("nodes").alias("node")).distinct()
        hit = left.select("key", F.explode("nodes").alias("node")).join(used, "node", "left_semi").select("key").distinct()
        old, left = left, stage(left.join(hit, "key", "left_anti"), "items")
        unstage(old)
    out = reread(taken).select("key.*") if taken else items.select("rank", "item").filter("false")
    return out.select("item", "rank")


def flip_simulation(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(a, b, face_a, face_b, c, d, old_quality, new_quality, valid) of the edges of two faces: c and d are the corners
    opposite to the edge in its lower and its higher face, the qualities the lower ones of both faces, before and after
    the edge joins c and d. Valid: four corners, c and d have no edge yet, no new face is without area."""
    e = joins.edges(faces, CORNERS, "face")
    two = e.filter("n_faces = 2 and face_a <> face_b")
    corner = faces.select("face", F.array(*CORNERS).alias("own"))
    for n in "ab":
        two = two.join(corner.select(F.col("face").alias(f"face_{n}"), F.col("own").alias(f"own_{n}")), f"face_{n}")
    rest = lambda n: F.filter(f"own_{n}", lambda v: (v != F.col("a")) & (v != F.col("b")))
    two = two.withColumn("rest_a", rest("a")).withColumn("rest_b", rest("b")).filter("size(rest_a) = 1 and size(rest_b) = 1")
    two = two.select("a", "b", "face_a", "face_b", F.col("rest_a")[0].alias("c"), F.col("rest_b")[0].alias("d"))
    for n in "abcd":
        two = two.join(vertices.select(F.col("vertex").alias(n), F.struct(*AXES).alias(f"p{n}")), n)
    joined = e.select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.lit(True).alias("there"))
    x = two.withColumn("lo", F.least("c", "d")).withColumn("hi", F.greatest("c", "d")).join(joined, ["lo", "hi"], "left")
    p = {n: V.of(f"p{n}") for n in "abcd"}
    for k, t in enumerate(("abc", "abd", "cdb", "dca")):
        i, j, m = (p[n] for n in t)
        x = x.withColumn(f"s{k}", V.norm(V.cross(V.sub(j, i), V.sub(m, i))))
        x = x.withColumn(f"q{k}", _quality(i, j, m, F.col(f"s{k}")))
    valid = (F.col("c") != F.col("d")) & F.col("there").isNull() & (F.col("s2") > 1e-12) & (F.col("s3") > 1e-12)
    return x.select("a", "b", "face_a", "face_b", "c", "d", F.least("q0", "q1").alias("old_quality"), F.least("q2", "q3").alias("new_quality"), valid.alias("valid"))


def flip_pass(faces: DataFrame, vertices: DataFrame, scores: DataFrame, gain: float, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Faces after a pass of flips, and the flips (a, b, face_a, face_b, c, d, old_quality, new_quality, rank). scores (a,
    b, score) rank edges, the highest first, ties by a and b; those of 0 and less stay. A flip must be valid, gain at
    least `gain` in its worse face, and share no corner with one of a higher rank that was taken; the first `most` are."""
    two = flip_simulation(faces, vertices).join(scores.filter("score > 0").select("a", "b", (-F.col("score")).alias("turned")), ["a", "b"])
    ranked = stage(numbered(two, ["turned", "a", "b"], "rank"), "flips")
    fit = ranked.filter(F.col("valid") & (F.col("new_quality") - F.col("old_quality") >= gain))
    took = independent(fit.select(F.col("rank").alias("item"), "rank", F.array("a", "b", "c", "d").alias("nodes"))).select("rank")
    if most is not None:
        took = took.orderBy("rank").limit(most)
    flips = stage(ranked.join(took, "rank", "left_semi"), "taken")
    new = flips.select(F.explode(F.array(F.struct(F.col("face_a").alias("face"), F.array("c", "d", "b").alias("new")), F.struct(F.col("face_b").alias("face"), F.array("d", "c", "a").alias("new")))).alias("n")).select("n.*")
    out = faces.join(new, "face", "left").select("face", *[F.coalesce(F.col("new")[k], F.col(c)).alias(c) for k, c in enumerate(CORNERS)])
    return out, flips.select("a", "b", "face_a", "face_b", "c", "d", "old_quality", "new_quality", "rank")
