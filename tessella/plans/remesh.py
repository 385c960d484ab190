"""Patches, collapses and flips on a terrain whose heights are counts of line items by their keys' residues: a vertex for
each cell of a 30 by 30 grid that has line items, two faces for each square of four such vertices."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessella.operators import cameras as Q
from tessella.operators import joins as J
from tessella.operators import mesh as M
from tessella.operators import nearest as N
from tessella.operators import patches as H
from tessella.operators import remesh as X
from tessella.staging import stage

from .catalog import query, r

GROUND = "SELECT v, (v // 30) + (n % 5) / 20 x, (v % 30) + (n % 7) / 20 y, (n % 11) / 8 z FROM (SELECT (l_orderkey % 30) * 30 + l_partkey % 30 v, count(*) n FROM lineitem GROUP BY 1)"
TILES = "SELECT f, p, q, s FROM (SELECT 2 * v f, v p, v + 30 q, v + 1 s FROM v UNION ALL SELECT 2 * v + 1, v + 30, v + 31, v + 1 FROM v) WHERE f % 60 < 58 AND f < 1740 AND p IN (SELECT v FROM v) AND q IN (SELECT v FROM v) AND s IN (SELECT v FROM v)"
LAND = f"""v AS MATERIALIZED ({GROUND}), t AS MATERIALIZED ({TILES}),
  h AS (SELECT f, p a, q b FROM t UNION ALL SELECT f, q, s FROM t UNION ALL SELECT f, s, p FROM t),
  e AS MATERIALIZED (SELECT least(a, b) a, greatest(a, b) b, min(f) fa, CASE WHEN count(*) > 1 THEN max(f) END fb, count(*) n FROM h GROUP BY 1, 2)"""


def _cross(p: str, q: str, s: str) -> list[str]:
    d = lambda k, u, w: f"({w}{k} - {u}{k})"
    return [f"({d(i, p, q)} * {d(j, p, s)} - {d(j, p, q)} * {d(i, p, s)})" for i, j in ("yz", "zx", "xy")]


def _doubled(p: str, q: str, s: str) -> str:
    return f"sqrt({' + '.join(f'{c} * {c}' for c in _cross(p, q, s))})"


def _quality(p: str, q: str, s: str) -> str:
    e = " + ".join(f"({u}{k} - {w}{k}) ** 2" for u, w in ((p, q), (q, s), (s, p)) for k in "xyz")
    return f"(2 * sqrt(3) * {_doubled(p, q, s)} / greatest({e}, 1e-18))"


def _ground(t):
    n = t("lineitem").groupBy(((F.col("l_orderkey") % 30) * 30 + F.col("l_partkey") % 30).alias("vertex")).agg(F.count(F.lit(1)).alias("n"))
    v = F.col("vertex")
    return n.select("vertex", (F.floor(v / 30) + F.col("n") % 5 / 20).alias("x"), (v % 30 + F.col("n") % 7 / 20).alias("y"), (F.col("n") % 11 / 8).alias("z"))


def _tiles(t, ground=None):
    v, ground = F.col("vertex"), (ground or _ground(t)).select("vertex")
    two = F.explode(F.array(F.struct((2 * v).alias("face"), v.alias("v0"), (v + 30).alias("v1"), (v + 1).alias("v2")), F.struct((2 * v + 1).alias("face"), (v + 30).alias("v0"), (v + 31).alias("v1"), (v + 1).alias("v2"))))
    out = ground.filter("vertex % 30 < 29 and vertex < 870").select(two.alias("f")).select("f.*")
    for c in X.CORNERS:
        out = out.join(ground.withColumnRenamed("vertex", c), c, "left_semi")
    return out.select("face", *X.CORNERS)


_N = _cross("p.", "q.", "s.")
_AREA = "sqrt(m0 * m0 + m1 * m1 + m2 * m2)"


@query(f"""WITH {LAND}, g AS (SELECT t.*, p.x px, p.y py, p.z pz, {_N[0]} m0, {_N[1]} m1, {_N[2]} m2 FROM t JOIN v p ON p.v = t.p JOIN v q ON q.v = t.q JOIN v s ON s.v = t.s),
  u AS (SELECT *, {_AREA} l, m0 / greatest({_AREA}, 1e-12) n0, m1 / greatest({_AREA}, 1e-12) n1, m2 / greatest({_AREA}, 1e-12) n2 FROM g),
  d AS (SELECT *, -(n0 * px + n1 * py + n2 * pz) d FROM u)
  SELECT vertex, round(sum(l / 2 * n0 * n0), 5) a00, round(sum(l / 2 * n2 * n2), 5) a22, round(sum(l / 2 * n0 * n1), 5) + 0.0 a01, round(sum(l / 2 * n1 * d), 4) + 0.0 b1, round(sum(l / 2 * d * d), 3) c
  FROM (SELECT *, unnest([p, q, s]) vertex FROM d) GROUP BY vertex""")
def vertex_quadrics(t):
    q = X.quadrics(_tiles(t), _ground(t))
    return q.select("vertex", r("a00", 5).alias("a00"), r("a22", 5).alias("a22"), (r("a01", 5) + 0.0).alias("a01"), (r("b1") + 0.0).alias("b1"), r("c", 3).alias("c"))


def _at(k: str) -> str:
    return ", ".join(f"CASE WHEN {k} IN (a, b) THEN m{c} ELSE {k}_.{c} END {k}{c}" for c in "xyz")


_NEW, _OLD = _cross("p", "q", "s"), _cross("p_.", "q_.", "s_.")


@query(f"""WITH {LAND}, m AS (SELECT a, b, (i.x + j.x) / 2 mx, (i.y + j.y) / 2 my, (i.z + j.z) / 2 mz FROM e JOIN v i ON i.v = a JOIN v j ON j.v = b),
  c AS (SELECT f, unnest([p, q, s]) k FROM t), o AS (SELECT a, b, f FROM m JOIN c ON k = a UNION SELECT a, b, f FROM m JOIN c ON k = b),
  w AS (SELECT a, b, {_at("p")}, {_at("q")}, {_at("s")}, {", ".join(f"{x} o{k}" for k, x in enumerate(_OLD))} FROM o JOIN m USING (a, b) JOIN t USING (f) JOIN v p_ ON p_.v = p JOIN v q_ ON q_.v = q JOIN v s_ ON s_.v = s
    WHERE (a IN (p, q, s)) <> (b IN (p, q, s))),
  y AS (SELECT a, b, {_doubled("p", "q", "s")} l, ({" + ".join(f"{x} * o{k}" for k, x in enumerate(_NEW))}) / greatest({_doubled("p", "q", "s")}, 1e-12) / greatest(sqrt(o0 * o0 + o1 * o1 + o2 * o2), 1e-12) cosine, {_quality("p", "q", "s")} q FROM w),
  z AS (SELECT a, b, bool_and(l > 1e-12 AND cosine > 0) topology_ok, max(CASE WHEN l > 1e-12 THEN greatest(1 - greatest(least(cosine, 1), -1), 0) END) turn, min(CASE WHEN l > 1e-12 THEN q END) low,
    sum(CASE WHEN l > 1e-12 THEN greatest(0.8 - q, 0) ** 2 END) lacks FROM y GROUP BY a, b)
  SELECT e.a, e.b, coalesce(topology_ok, false) topology_ok, coalesce(low >= 0.3, false) quality_ok, round(0.5 * turn / (1 - cos(0.35)), 4) normal_error, round(lacks, 5) quality_error, round(coalesce(low, 0), 5) min_quality FROM e LEFT JOIN z USING (a, b)""")
def collapse_simulation(t):
    f, v = _tiles(t), _ground(t)
    e = J.edges(f, X.CORNERS, "face").select("a", "b")
    for c in "ab":
        e = e.join(v.select(F.col("vertex").alias(c), F.struct("x", "y", "z").alias(f"p{c}")), c)
    moves = e.select("a", "b", *[((F.col(f"pa.{c}") + F.col(f"pb.{c}")) / 2).alias(c) for c in "xyz"], F.lit(0.5).alias("detail"), F.lit(0.35).alias("tau"))
    g = X.collapse_simulation(f, v, moves, hard=0.3, soft=0.8)
    known = lambda c: F.when(F.col(c) < float("inf"), F.col(c))
    return g.select("a", "b", "topology_ok", "quality_ok", r(known("normal_error")).alias("normal_error"), r(known("quality_error"), 5).alias("quality_error"), r("min_quality", 5).alias("min_quality"))


def _four(names: str) -> str:
    return ", ".join(f"{n}_.{c} {n}0{c}" for n in names for c in "xyz")


@query(f"""WITH {LAND}, w AS (SELECT e.*, [i.p, i.q, i.s] oa, [j.p, j.q, j.s] ob FROM e JOIN t i ON i.f = fa JOIN t j ON j.f = fb WHERE n = 2),
  k AS (SELECT a, b, fa face_a, fb face_b, list_filter(oa, lambda u: u <> a AND u <> b)[1] c, list_filter(ob, lambda u: u <> a AND u <> b)[1] d FROM w),
  x AS (SELECT k.*, {_four("abcd")} FROM k JOIN v a_ ON a_.v = a JOIN v b_ ON b_.v = b JOIN v c_ ON c_.v = c JOIN v d_ ON d_.v = d)
  SELECT a, b, face_a, face_b, c, d, round(least({_quality("a0", "b0", "c0")}, {_quality("a0", "b0", "d0")}), 5) old_quality, round(least({_quality("c0", "d0", "b0")}, {_quality("d0", "c0", "a0")}), 5) new_quality,
    c <> d AND NOT EXISTS (SELECT 1 FROM e WHERE e.a = least(x.c, x.d) AND e.b = greatest(x.c, x.d)) AND {_doubled("c0", "d0", "b0")} > 1e-12 AND {_doubled("d0", "c0", "a0")} > 1e-12 AS "valid" FROM x""")
def flip_simulation(t):
    g = X.flip_simulation(_tiles(t), _ground(t))
    return g.withColumn("old_quality", r("old_quality", 5)).withColumn("new_quality", r("new_quality", 5))


@query()
def collapse_pass(t):
    """The log of a pass; tests hold it and the mesh after it against a serial scan."""
    return X.collapse_pass(_tiles(t), _ground(t), most_cost=0.05, soft=0.6)[2]


@query()
def flip_pass(t):
    f = _tiles(t)
    score = J.edges(f, X.CORNERS, "face").select("a", "b", ((F.col("a") * F.col("a") + F.col("b") * 3) % 10 / 10).alias("score"))
    return X.flip_pass(f, _ground(t), score, gain=0.01)[1]


@query()
def planar_patches(t):
    """Patches of the terrain's faces; edges whose ends' sum is a multiple of 13 are borders."""
    f = _tiles(t)
    g = M.geometry(M.with_corners(f, _ground(t), "face", X.CORNERS, "vertex", X.AXES))
    shapes = g.select("face", *H.SHAPE, "area", F.lit(1.0).alias("planar"), (0.25 * F.col("mean_edge")).alias("eps"))
    links = J.edges(f, X.CORNERS, "face").filter("n_faces = 2 and (a + b) % 13 <> 0").select(F.col("face_a").alias("a"), F.col("face_b").alias("b"))
    return H.planar_patches(shapes, links, math.degrees(0.7), 2.0, 1.0, 4, 0.5)[1]


def _land(t):
    """The terrain's faces; line items are read once for it."""
    ground = stage(_ground(t), "ground")
    return stage(M.with_corners(_tiles(t, ground), ground, "face", X.CORNERS, "vertex", X.AXES), "land")


def _dots(u: str, w: str) -> str:
    return "(" + " + ".join(f"({a}) * ({b})" for a, b in zip(u.split("|"), w.split("|"), strict=True)) + ")"


def _minus(u: str, w: str) -> str:
    return "|".join(f"{u}{k} - {w}{k}" for k in "xyz")


def _side(u: str, w: str) -> str:
    """Squared distance of o to the side from u to w."""
    t = f"greatest(0, least(1, {_dots(_minus('o.', u), _minus(w, u))} / {_dots(_minus(w, u), _minus(w, u))}))"
    away = "|".join(f"o.{k} - {u}{k} - {t} * ({w}{k} - {u}{k})" for k in "xyz")
    return _dots(away, away)


def _points(t):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", (k * 7 % 400 / 10.0 - 5).alias("x"), (k * 13 % 370 / 10.0 - 4).alias("y"), (k * 11 % 90 / 20.0 - 1).alias("z"))


_UP = "|".join(_N)


@query(f"""WITH {LAND}, o AS (SELECT p_partkey, p_partkey * 7 % 400 / 10 - 5 x, p_partkey * 13 % 370 / 10 - 4 y, p_partkey * 11 % 90 / 20 - 1 z FROM part),
  k AS (SELECT p_partkey, {_dots(_UP, _UP)} m2, {_dots(_minus('o.', 'p.'), _UP)} h, {_dots('|'.join(_cross('p.', 'o.', 's.')), _UP)} i, {_dots('|'.join(_cross('p.', 'q.', 'o.')), _UP)} j,
    least({_side('p.', 'q.')}, {_side('q.', 's.')}, {_side('s.', 'p.')}) d2 FROM o, t JOIN v p ON p.v = t.p JOIN v q ON q.v = t.q JOIN v s ON s.v = t.s)
  SELECT p_partkey, round(sqrt(min(CASE WHEN i >= 0 AND j >= 0 AND i + j <= m2 THEN h * h / m2 ELSE d2 END)), 4) distance FROM k GROUP BY p_partkey""")
def nearest_triangle(t):
    return N.nearest_triangles(_points(t), _land(t), "p_partkey").select("p_partkey", r("distance").alias("distance"))


@query()
def reparented(t):
    """Parts as children with two scales and a main axis, bound to the terrain; tests hold it against a dense search."""
    k = F.col("p_partkey")
    axis = [(k * m % 19 - 9.5).alias(f"u{c}") for m, c in ((3, "x"), (5, "y"), (7, "z"))]
    sizes = t("part").select("p_partkey", (F.col("p_size") / 100.0).alias("sx"), (k % 40 / 100.0).alias("sy"), *axis)
    return N.reparented(_points(t).join(sizes, "p_partkey"), _land(t), 0.1, 2.0, "p_partkey")


def _solved(k: int) -> str:
    a = [[f"a{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    det = lambda m: " + ".join(f"({m[0][i]}) * ({m[1][(i + 1) % 3]} * {m[2][(i + 2) % 3]} - {m[1][(i + 2) % 3]} * {m[2][(i + 1) % 3]})" for i in range(3))
    swapped = [[f"b{i}" if j == k else a[i][j] for j in range(3)] for i in range(3)]
    return f"({det(swapped)}) / ({det(a)})"


PLANES = "SELECT patch, (patch + 1) / l nx, (patch * 3 % 7 - 3) / l ny, 4 / l nz, -(patch + 20) / l d FROM (SELECT patch, sqrt((patch + 1) ** 2 + (patch * 3 % 7 - 3) ** 2 + 16) l FROM range(0, 9) r(patch))"


@query(f"""WITH {LAND}, o AS (SELECT f, CASE WHEN f % 17 > 0 THEN f // 60 % 9 END patch FROM t), n AS ({PLANES}),
  m AS (SELECT DISTINCT vertex, patch FROM (SELECT f, unnest([p, q, s]) vertex FROM t) JOIN o USING (f)),
  y AS (SELECT vertex, count(*) k, {", ".join(f"sum(n{x} * n{y}){' + 0.01' if x == y else ''} a{i}{j}" for i, x in enumerate("xyz") for j, y in enumerate("xyz") if i <= j)}, {", ".join(f"-sum(n{x} * d) + 0.01 * any_value(v.{x}) b{i}" for i, x in enumerate("xyz"))},
    {", ".join(f"any_value(v.{x}) - (sum(nx * n{x}) * any_value(v.x) + sum(ny * n{x}) * any_value(v.y) + sum(nz * n{x}) * any_value(v.z) + sum(d * n{x})) f{i}" for i, x in enumerate("xyz"))}
    FROM m JOIN n USING (patch) JOIN v ON v.v = vertex WHERE vertex NOT IN (SELECT vertex FROM m WHERE patch IS NULL) GROUP BY vertex),
  w AS (SELECT v.v vertex, v.x x0, v.y y0, v.z z0, {", ".join(f"CASE WHEN k = 1 THEN f{i} WHEN k > 1 THEN {_solved(i)} ELSE v.{x} END {x}" for i, x in enumerate("xyz"))} FROM v LEFT JOIN y ON y.vertex = v.v)
  SELECT vertex, round(x, 4) + 0.0 x, round(y, 4) + 0.0 y, round(z, 4) + 0.0 z, round(sqrt((x - x0) ** 2 + (y - y0) ** 2 + (z - z0) ** 2), 4) moved FROM w""")
def project_vertices(t):
    """The terrain's vertices onto nine planes; a face's plane goes by its row of the grid, every seventeenth has none."""
    f = _tiles(t)
    k = F.col("patch")
    long = F.sqrt((k + 1) ** 2 + (k * 3 % 7 - 3) ** 2 + 16)
    planes = t("lineitem").sparkSession.range(9).withColumnRenamed("id", "patch").select("patch", ((k + 1) / long).alias("nx"), ((k * 3 % 7 - 3) / long).alias("ny"), (4 / long).alias("nz"), (-(k + 20) / long).alias("d"))
    own = f.filter("face % 17 > 0").select("face", (F.floor(F.col("face") / 60) % 9).alias("patch"))
    got = H.project_vertices(_ground(t), f, X.CORNERS, own, planes, 0.01)
    return got.select("vertex", *[(r(c) + 0.0).alias(c) for c in "xyz"], r("moved").alias("moved"))


CAMERAS = "SELECT s_suppkey, cos(a) r00, -sin(a) * cos(b) r01, sin(a) * sin(b) r02, sin(a) r10, cos(a) * cos(b) r11, -cos(a) * sin(b) r12, 0.0 r20, sin(b) r21, cos(b) r22, s_acctbal / 1000 tx, s_suppkey % 37 / 4 - 3 ty, s_nationkey / 5 tz FROM (SELECT *, radians(s_suppkey * 29 % 360) a, radians(60 + s_suppkey * 7 % 50) b FROM supplier)"
_K = [["0", "ux", "0"], ["-ux", "0", "-uz"], ["0", "uz", "0"]]
_TURN = [[f"({int(i == j)} + {_K[i][j]} + ({' + '.join(f'({_K[i][m]}) * ({_K[m][j]})' for m in range(3))}) / (1 - uy))" for j in range(3)] for i in range(3)]


def _row(i: int, v: list[str]) -> str:
    return " + ".join(f"a{i}{m} * {v[m]}" for m in range(3))


@query(f"""WITH k AS ({CAMERAS}), w AS (SELECT -avg(r01) ux, -avg(r11) uy, -avg(r21) uz FROM k), u AS (SELECT ux / l ux, uy / l uy, uz / l uz FROM (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) l FROM w)),
  a AS (SELECT {", ".join(f"{_TURN[i][j]} a{i}{j}" for i in range(3) for j in range(3))} FROM u),
  x AS (SELECT {", ".join(f"{_row(i, ['tx', 'ty', 'tz'])} t{i}, {_row(i, ['r02', 'r12', 'r22'])} f{i}" for i in range(3))} FROM k, a), y AS (SELECT *, f0 * t0 + f1 * t1 + f2 * t2 s FROM x),
  c AS (SELECT {", ".join(f"median(t{i} - s * f{i}) c{i}" for i in range(3))} FROM y), g AS (SELECT 1 / median(sqrt((t0 - c0) ** 2 + (t1 - c1) ** 2 + (t2 - c2) ** 2)) scale FROM y, c)
  SELECT {", ".join(f"round(a{i}{j} * scale, 5) + 0.0 m{i}{j}" for i in range(3) for j in range(3))}, {", ".join(f"round(-c{i} * scale, 5) + 0.0 m{i}3" for i in range(3))}, round(scale, 5) scale FROM a, c, g""")
def camera_similarity(t):
    s = t("supplier")
    a, b = F.radians(F.col("s_suppkey") * 29 % 360), F.radians(60 + F.col("s_suppkey") * 7 % 50)
    turn = [F.cos(a), -F.sin(a) * F.cos(b), F.sin(a) * F.sin(b), F.sin(a), F.cos(a) * F.cos(b), -F.cos(a) * F.sin(b), F.lit(0.0), F.sin(b), F.cos(b)]
    cameras = s.select(*[x.alias(n) for x, n in zip(turn, Q.ROTATION, strict=True)], (F.col("s_acctbal") / 1000).alias("tx"), (F.col("s_suppkey") % 37 / 4 - 3).alias("ty"), (F.col("s_nationkey") / 5).alias("tz"))
    got = Q.similarity(cameras)
    return got.select(*[(r(c, 5) + 0.0).alias(c) for c in got.columns])
