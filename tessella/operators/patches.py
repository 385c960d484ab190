"""Planar patches: regions grown from ranked seeds, each accepting the faces that fit its seed's plane, then refitted
and trimmed. Faces are rows (face, cx, cy, cz, nx, ny, nz, area, planar, eps) with a unit normal."""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.staging import reread, stage, unstage

from . import planes
from .graph import components
from .windows import numbered

SHAPE = ["cx", "cy", "cz", "nx", "ny", "nz"]


def fits(plane: Column, shape: Column, eps: Column, cosine: float, distance: float) -> Column:
    """Whether a face (struct of centre, normal) fits a plane (struct nx, ny, nz, d) in direction and distance."""
    turn = sum((plane[a] * shape[a] for a in ("nx", "ny", "nz")), F.lit(0.0))
    away = sum((plane[f"n{a}"] * shape[f"c{a}"] for a in "xyz"), plane["d"])
    flat = sum((shape[a] * shape[a] for a in ("nx", "ny", "nz")), F.lit(0.0)) > 1e-24
    return flat & (F.abs(turn) >= cosine) & (F.abs(away) <= distance * F.greatest(eps, F.lit(1e-6)))


def _grow_in_task(links_of: dict[int, list[int]], rows: dict[int, tuple], cosine: float, distance: float) -> dict[int, int]:
    """Face to seed: the smallest face that is left takes all it reaches over faces that fit its plane. rows: face to
    (centre, normal, eps, plane)."""
    seed_of: dict[int, int] = {}
    for seed in sorted(rows):
        if seed in seed_of:
            continue
        seed_of[seed], reached = seed, [seed]
        px, py, pz, d = rows[seed][3]
        while reached:
            for f in links_of[reached.pop()]:
                if f not in seed_of:
                    (cx, cy, cz), (nx, ny, nz), eps, _ = rows[f]
                    fit = nx * nx + ny * ny + nz * nz > 1e-24 and abs(px * nx + py * ny + pz * nz) >= cosine
                    if fit and abs(px * cx + py * cy + pz * cz + d) <= distance * max(eps, 1e-6):
                        seed_of[f] = seed
                        reached.append(f)
    return seed_of


def grown(faces: DataFrame, links: DataFrame, degrees: float, distance: float, most: int = 200_000) -> DataFrame:
    """(face, seed) as a scan of seeds by face id would take them. faces also have their plane, a struct (nx, ny, nz, d)
    that they accept others by when they are seeds; links (a, b) join faces that a region may cross.

    Which face a region takes hangs on the regions before it, so regions are found inside components of a wider
    relation, over which no region passes: links of which one end fits the other's plane, or whose normals are no
    further apart than two faces of one region can be. Components of up to `most` faces are each scanned in a task. Of
    larger ones the smallest face's region is the component that its fitting faces form around it; it is taken away,
    and what is left falls into components anew."""
    cosine, apart = math.cos(math.radians(degrees)), math.cos(math.radians(min(90.0, 2 * degrees)))
    left = stage(faces.select("face", F.struct(*SHAPE).alias("shape"), "eps", "plane"), "faces")
    ends = [left.select(F.col("face").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("shape", "eps", "plane")]) for k in "ab"]
    met = links.select("a", "b").filter("a <> b").distinct().join(ends[0], "a").join(ends[1], "b")
    near = F.abs(sum((F.col("shape_a")[c] * F.col("shape_b")[c] for c in ("nx", "ny", "nz")), F.lit(0.0))) >= apart - 1e-9
    one = fits(F.col("plane_a"), F.col("shape_b"), F.col("eps_b"), cosine, distance)
    other = fits(F.col("plane_b"), F.col("shape_a"), F.col("eps_a"), cosine, distance)
    open_links, done = stage(met.filter(near | one | other).select("a", "b"), "links"), []
    while True:
        roots = components(open_links)
        named = left.join(roots.withColumnRenamed("node", "face"), "face", "left").withColumn("root", F.coalesce("root", "face"))
        size = named.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        sized = stage(named.join(size, "root"), "sized")
        linked = stage(open_links.join(sized.select(F.col("face").alias("a"), "root", "n"), "a"), "linked")
        unstage(open_links)
        open_links = linked

        def scan(key, f: pa.Table, e: pa.Table) -> pa.Table:
            rows = {}
            for r in f.to_pylist():
                s, p = r["shape"], r["plane"]
                rows[r["face"]] = ((s["cx"], s["cy"], s["cz"]), (s["nx"], s["ny"], s["nz"]), r["eps"], (p["nx"], p["ny"], p["nz"], p["d"]))
            links_of = defaultdict(list)
            for a, b in zip(e["a"].to_pylist(), e["b"].to_pylist(), strict=True):
                links_of[a].append(b)
                links_of[b].append(a)
            got = _grow_in_task(links_of, rows, cosine, distance)
            return pa.table({"face": pa.array(got.keys(), pa.int64()), "seed": pa.array(got.values(), pa.int64())})

        few = sized.filter(F.col("n") <= most)
        f = few.select("root", F.col("face").cast("long").alias("face"), "shape", "eps", "plane").groupBy("root")
        e = open_links.filter(F.col("n") <= most).select(F.col("root").alias("home"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).groupBy("home")
        done.append(stage(f.cogroup(e).applyInArrow(scan, "face long, seed long"), "grown"))
        many = sized.filter(F.col("n") > most)
        if not many.limit(1).count():
            unstage(left, sized, open_links)
            return reread(done)
        # the smallest face of a component is its root
        seeds = many.filter("face = root").select("root", F.col("plane").alias("of_seed"))
        ok = many.join(seeds, "root").filter((F.col("face") == F.col("root")) | fits(F.col("of_seed"), F.col("shape"), F.col("eps"), cosine, distance)).select("face", "root")
        inside = open_links.filter(F.col("n") > most).join(ok.select(F.col("face").alias("a")), "a", "left_semi").join(ok.select(F.col("face").alias("b")), "b", "left_semi")
        region = components(inside).select(F.col("node").alias("face"), F.col("root").alias("seed"))
        taken = stage(ok.join(region, "face", "left").withColumn("seed", F.coalesce("seed", "face")).filter("seed = root").select(F.col("face").cast("long").alias("face"), F.col("seed").cast("long").alias("seed")), "grown")
        done.append(taken)
        gone = taken.select("face")
        rest = stage(many.join(gone, "face", "left_anti").select("face", "shape", "eps", "plane"), "faces")
        between = open_links.filter(F.col("n") > most)
        for c in "ab":
            between = between.join(gone.withColumnRenamed("face", c), c, "left_anti")
        between = stage(between.select("a", "b"), "links")
        unstage(left, sized, open_links)
        left, open_links = rest, between


def planar_patches(
    faces: DataFrame, links: DataFrame, degrees: float, distance: float, trim: float, least: int, planar: float, most: int = 200_000
) -> tuple[DataFrame, DataFrame]:
    """The faces (face, patch), and the patches (patch, seed, n_faces, area, planar_mean, nx, ny, nz, d, residual_mean,
    residual_max), numbered by seed. Only faces with planar of at least `planar` take part. A region of `least` faces or
    more is fitted with weights area * planar, faces that don't fit its own plane by `trim` leave it, and if `least` are
    left it is fitted once more. Normals point with the area's sum of face normals."""
    take = faces.filter(F.col("planar") >= planar)
    if "plane" not in faces.columns:
        take = take.withColumn("plane", F.struct("nx", "ny", "nz", (-(F.col("nx") * F.col("cx") + F.col("ny") * F.col("cy") + F.col("nz") * F.col("cz"))).alias("d")))
    own = grown(take, links, degrees, distance, most)
    member = take.join(own, "face").withColumn("w", F.greatest(F.col("area") * F.col("planar"), F.lit(1e-8)))
    cosine = math.cos(math.radians(degrees))
    first = _fitted(member, least)
    trimmed = member.join(first.select("seed", F.struct("nx", "ny", "nz", "d").alias("fit")), "seed").filter(fits(F.col("fit"), F.struct(*SHAPE), F.col("eps"), cosine, trim)).drop("fit")
    trimmed = stage(trimmed, "patch-faces")
    second = _fitted(trimmed, least).withColumnsRenamed({"nx": "px", "ny": "py", "nz": "pz", "d": "pd"})
    away = F.abs(F.col("px") * F.col("cx") + F.col("py") * F.col("cy") + F.col("pz") * F.col("cz") + F.col("pd"))
    each = trimmed.join(second.select("seed", "px", "py", "pz", "pd"), "seed").groupBy("seed")
    more = each.agg(F.sum("area").alias("area"), F.avg("planar").alias("planar_mean"), F.avg(away).alias("residual_mean"), F.max(away).alias("residual_max"))
    named = numbered(second.join(more, "seed"), ["seed"], "patch")
    patches = stage(named.select("patch", "seed", "n_faces", "area", "planar_mean", F.col("px").alias("nx"), F.col("py").alias("ny"), F.col("pz").alias("nz"), F.col("pd").alias("d"), "residual_mean", "residual_max"), "patches")
    return trimmed.join(patches.select("seed", "patch"), "seed").select("face", "patch"), patches


def _fitted(member: DataFrame, least: int) -> DataFrame:
    """(seed, n_faces, nx, ny, nz, d) of regions of at least `least` faces; where the points give no plane, the faces'
    own direction does."""
    fit = stage(planes.fit(member.select("seed", "w", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")), ["seed"], "w"), "fits")
    size = F.greatest(F.col("area"), F.lit(1e-12))
    way = member.groupBy("seed").agg(*[F.sum(F.col(a) * size).alias(f"s{a[1]}") for a in ("nx", "ny", "nz")])
    long = F.greatest(F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2), F.lit(1e-12))
    x = fit.filter(F.col("n") >= least).join(way, "seed")
    for a in "xyz":
        x = x.withColumn(f"v{a}", F.coalesce(f"n{a}", F.col(f"s{a}") / long))
    sign = F.when(F.col("vx") * F.col("sx") + F.col("vy") * F.col("sy") + F.col("vz") * F.col("sz") < 0, -1.0).otherwise(1.0)
    x = x.withColumn("sign", sign)
    unit = [(F.col(f"v{a}") * F.col("sign")).alias(f"n{a}") for a in "xyz"]
    d = -(F.col("vx") * F.col("cx") + F.col("vy") * F.col("cy") + F.col("vz") * F.col("cz")) * F.col("sign")
    return x.select("seed", F.col("n").alias("n_faces"), *unit, d.alias("d"))


def project_vertices(vertices: DataFrame, faces: DataFrame, corners: list[str], own: DataFrame, patches: DataFrame, reg: float) -> DataFrame:
    """(vertex, x, y, z, moved): vertices (vertex, x, y, z) all of whose faces (face, corners) have a patch in own (face,
    patch) move onto the planes (patch, nx, ny, nz, d) of these: to the foot on the only one, or to where the squared
    distances to several, plus `reg` times that to the old place, are least. All others stay. A vertex's planes are
    summed to one 3 x 3 system, solved in closed form."""
    each = faces.join(own.select("face", "patch"), "face", "left").select("patch", F.explode(F.array(*corners)).alias("vertex"))
    member = each.groupBy("vertex", "patch").agg(F.count(F.lit(1)).alias("_n"))
    free = member.filter("patch is null").select("vertex")
    n, d = [F.col(f"n{a}") for a in "xyz"], F.col("d")
    terms = {f"_{i}{j}": F.sum(n[i] * n[j]) for i in range(3) for j in range(i, 3)} | {f"_b{i}": -F.sum(n[i] * d) for i in range(3)}
    system = member.join(patches.select("patch", "nx", "ny", "nz", "d"), "patch").groupBy("vertex").agg(F.count(F.lit(1)).alias("_planes"), *[c.alias(k) for k, c in terms.items()])
    x = vertices.select("vertex", "x", "y", "z").join(system.join(free, "vertex", "left_anti"), "vertex", "left")
    # one plane: as the weight of the old place goes to nothing, the least error is at the foot
    p = [F.col(c) for c in "xyz"]
    m = [[F.col(f"_{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    foot = [p[i] - (sum((m[i][j] * p[j] for j in range(3)), F.lit(0.0)) - F.col(f"_b{i}")) for i in range(3)]
    reg = max(reg, 1e-12)
    x = x.withColumns({f"_f{i}": foot[i] for i in range(3)} | {f"_{i}{i}": m[i][i] + reg for i in range(3)} | {f"_b{i}": F.col(f"_b{i}") + reg * p[i] for i in range(3)})
    side = [F.col(f"_b{i}") for i in range(3)]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    dot = lambda u, v: sum((a * b for a, b in zip(u, v, strict=True)), F.lit(0.0))
    det = dot(m[0], cross(m[1], m[2]))
    solved = [dot(side, cross(m[(k + 1) % 3], m[(k + 2) % 3])) / det for k in range(3)]  # symmetric: rows are columns
    at = [F.when(F.col("_planes") == 1, F.col(f"_f{k}")).when(F.col("_planes") > 1, solved[k]).otherwise(p[k]).alias(f"_to{k}") for k in range(3)]
    x = x.select("vertex", "x", "y", "z", *at)
    moved = F.sqrt(sum(((F.col(f"_to{k}") - p[k]) ** 2 for k in range(3)), F.lit(0.0)))
    return x.select("vertex", *[F.col(f"_to{k}").alias(c) for k, c in enumerate("xyz")], moved.alias("moved"))
