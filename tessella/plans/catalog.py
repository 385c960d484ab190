"""The operators applied to the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import camera as C
from tessella.functions import scalar as S
from tessella.operators import aggregates as A
from tessella.operators import clusters as K
from tessella.operators import graph as G
from tessella.operators import joins as J
from tessella.operators import planes as P
from tessella.operators import rasters as R
from tessella.operators import selection as L
from tessella.operators import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c, n: int = 4):
    return F.round(c, n)


@query("""SELECT o_orderkey, round(x * x * (3 - 2 * x), 6) step, round(sign(b) * ln(1 + abs(b)), 6) lg, round(ln(p / (1 - p)), 6) lgt,
  round(CASE WHEN abs(b) <= 10 THEN 0.05 * b * b ELSE abs(b) - 5 END, 6) hub, round(1 - (1 - x) * (1 - p), 6) por, round_even(o_totalprice / 1000, 0) half_even
  FROM (SELECT *, least(greatest(o_totalprice / 200000, 0), 1) x, o_totalprice / 1000 - 100 b, least(greatest(o_totalprice / 300000, 1e-6), 1 - 1e-6) p FROM orders)""")
def scalar_projections(t):
    x, b = F.col("o_totalprice") / 200000, F.col("o_totalprice") / 1000 - 100
    p = F.col("o_totalprice") / 300000
    return t("orders").select("o_orderkey", r(S.smoothstep01(x), 6).alias("step"), r(S.log_transform(b), 6).alias("lg"), r(S.logit_clamped(p), 6).alias("lgt"), r(S.huber(b, 10.0), 6).alias("hub"), r(S.smooth_max(x, S.clip(p, 1e-6, 1 - 1e-6)), 6).alias("por"), F.rint(F.col("o_totalprice") / 1000).alias("half_even"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug FROM part")
def slug_names(t):
    return t("part").select("p_partkey", S.slug(F.col("p_type")).alias("slug"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v)), 3) > 0 nonzero, round(CAST(embedding[1] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 1e-12), 4) first_unit FROM embeddings")
def unit_vectors(t):
    u = S.unit(F.col("embedding"))
    return t("embeddings").select("vec_id", (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x) > 0).alias("nonzero"), r(u[0]).alias("first_unit"))


@query("""SELECT l_returnflag, l_linestatus, count(*) count, round(min(l_extendedprice), 4) min, round(quantile_cont(l_extendedprice, 0.25), 4) q25, round(quantile_cont(l_extendedprice, 0.5), 4) median,
  round(avg(l_extendedprice), 4) mean, round(quantile_cont(l_extendedprice, 0.75), 4) q75, round(quantile_cont(l_extendedprice, 0.9), 4) q90, round(max(l_extendedprice), 4) max FROM lineitem GROUP BY ALL""")
def column_profile(t):
    p = A.profile(t("lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return p.select("l_returnflag", "l_linestatus", "count", *[r(c).alias(c) for c in ("min", "q25", "median", "mean", "q75", "q90", "max")])


@query("SELECT l_shipmode, round(quantile_cont(q, 0.8), 4) q80 FROM (SELECT l_linenumber l_shipmode, l_quantity * l_discount q FROM lineitem) GROUP BY 1")
def group_quantile(t):
    x = t("lineitem").select(F.col("l_linenumber").alias("l_shipmode"), (F.col("l_quantity") * F.col("l_discount")).alias("q"))
    return A.group_quantile(x, "q", ["l_shipmode"], 0.8, "q80").withColumn("q80", r("q80"))


@query("SELECT c_mktsegment, round(mad(c_acctbal), 4) mad FROM customer GROUP BY 1")
def median_deviation(t):
    return A.mad(t("customer"), "c_acctbal", ["c_mktsegment"]).select("c_mktsegment", r("mad").alias("mad"))


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 3) mean, round(sum(l_quantity), 3) weight FROM lineitem GROUP BY 1")
def weighted_mean(t):
    return A.weighted_mean(t("lineitem"), "l_extendedprice", "l_quantity", ["l_suppkey"]).select("l_suppkey", r("mean", 3).alias("mean"), r("weight", 3).alias("weight"))


@query("""SELECT l_partkey, l_linenumber, votes, round(votes / s, 4) share FROM (SELECT l_partkey, l_linenumber, CAST(count(*) AS DOUBLE) votes, sum(count(*)) OVER (PARTITION BY l_partkey) s,
  row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_linenumber) rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1""")
def majority_label(t):
    return A.majority(t("lineitem"), "l_linenumber", ["l_partkey"]).withColumn("share", r("share"))


@query("""SELECT user_id, event_type, round(CAST(w AS DOUBLE), 3) votes FROM (SELECT user_id, event_type, sum(CASE WHEN value > 50 THEN 2.0 ELSE 1.0 END) w,
  row_number() OVER (PARTITION BY user_id ORDER BY sum(CASE WHEN value > 50 THEN 2.0 ELSE 1.0 END) DESC, min(event_id)) rn FROM events GROUP BY 1, 2) WHERE rn = 1""")
def weighted_majority_first(t):
    e = t("events").withColumn("w", F.when(F.col("value") > 50, 2.0).otherwise(1.0))
    return A.majority(e, "event_type", ["user_id"], weight="w", first="event_id").select("user_id", "event_type", r("votes", 3).alias("votes"))


@query("""WITH s AS (SELECT DISTINCT n_regionkey o, substr(n_name, 1, 1) i FROM nation), z AS (SELECT o, count(*) n FROM s GROUP BY o)
  SELECT a, b, round(c / (x.n + y.n - c), 4) iou FROM (SELECT p.o a, q.o b, count(*) c FROM s p JOIN s q ON p.i = q.i AND p.o < q.o GROUP BY ALL) JOIN z x ON x.o = a JOIN z y ON y.o = b""")
def set_iou(t):
    n = t("nation").select(F.col("n_regionkey").alias("o"), F.substring("n_name", 1, 1).alias("i"))
    return A.set_overlap(n, "o", "i").withColumn("iou", r("iou"))


@query("SELECT user_id, count(*) n, round(sum(value), 3) total, max(value) top FROM events GROUP BY 1")
def merge_partial_state(t):
    e = t("events")
    part = lambda d: d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("top"))
    m = A.merge_partials(part(e.filter("event_id % 2 = 0")), part(e.filter("event_id % 2 = 1")), ["user_id"])
    return m.select("user_id", "n", r("total", 3).alias("total"), "top")


@query("""SELECT part, round(sum(x * w) / sum(w), 3) AS mean, max(x) top FROM (SELECT unnest([l_partkey % 100, l_suppkey % 100, l_orderkey % 100]) part, l_extendedprice x, greatest(l_quantity, 1e-12) w FROM lineitem) GROUP BY 1""")
def scatter_mean_max(t):
    x = t("lineitem").select(*[(F.col(c) % 100).alias(c) for c in ("l_partkey", "l_suppkey", "l_orderkey")], "l_extendedprice", "l_quantity")
    s = A.scatter_to_parts(x, ["l_partkey", "l_suppkey", "l_orderkey"], "l_extendedprice", "l_quantity")
    return s.select("part", r("mean", 3).alias("mean"), "top")


@query("SELECT c_custkey, round(least(greatest(c_acctbal / greatest(q, 1e-6), 0), 1), 4) norm FROM customer JOIN (SELECT c_nationkey k, quantile_cont(c_acctbal, 0.95) q FROM customer GROUP BY 1) ON k = c_nationkey")
def quantile_normalise(t):
    return W.normalize_by_quantile(t("customer"), "c_acctbal", ["c_nationkey"]).select("c_custkey", r("norm").alias("norm"))


@query("""SELECT c_custkey, round(1 - CASE WHEN hi > lo THEN least(greatest((c_acctbal - lo) / (hi - lo), 0), 1) ELSE 0 END, 4) norm FROM customer
  JOIN (SELECT c_nationkey k, quantile_cont(c_acctbal, 0.1) lo, quantile_cont(c_acctbal, 0.9) hi FROM customer GROUP BY 1) ON k = c_nationkey""")
def inverse_normalise(t):
    return W.normalize_between(t("customer"), "c_acctbal", ["c_nationkey"], inverse=True).select("c_custkey", r("norm").alias("norm"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) smooth FROM events")
def trailing_mean(t):
    return W.trailing_mean(t("events"), "value", ["user_id"], ["ts", "event_id"], 5).select("event_id", r("smooth").alias("smooth"))


@query("SELECT l_partkey, l_extendedprice, id FROM (SELECT l_partkey, l_extendedprice, l_orderkey * 10 + l_linenumber id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) rn FROM lineitem) WHERE rn = 1")
def zbuffer_nearest(t):
    x = t("lineitem").select("l_partkey", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return W.nearest(x, ["l_partkey"], "l_extendedprice", "id")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, min(l_extendedprice) OVER (PARTITION BY l_partkey) lo FROM lineitem) WHERE l_extendedprice <= lo + 1000")
def zbuffer_band(t):
    return W.depth_band(t("lineitem"), ["l_partkey"], "l_extendedprice", 1000.0).select("l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT l_orderkey k, l_linenumber i, l_partkey i2, l_suppkey i3, l_extendedprice i4, least(l_discount * 8, 0.999) a, l_tax c FROM lineitem WHERE least(l_discount * 8, 0.999) >= 1.0 / 255),
  b AS (SELECT *, exp(sum(ln(1 - a)) OVER (PARTITION BY k ORDER BY i, i2, i3, i4 ROWS UNBOUNDED PRECEDING)) f FROM a)
  SELECT k l_orderkey, round(sum(f / (1 - a) * a * c), 5) color, round(sum(f / (1 - a) * a), 5) opacity, count(*) used FROM b WHERE f > 1e-4 GROUP BY 1""")
def ordered_composite(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_discount") * 8).alias("al"), "l_tax")
    c = W.composite(x, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "al", "l_tax")
    return c.select("l_orderkey", r("color", 5).alias("color"), r("opacity", 5).alias("opacity"), "used")


@query("""SELECT event_id FROM (SELECT event_id, value, lag(value) OVER w p, lead(value) OVER w n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p IS NULL OR n IS NULL OR (value > p AND value > n)""")
def local_maxima(t):
    return W.local_maxima(t("events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id")


@query("""WITH k AS (SELECT DISTINCT o_custkey k, o_orderkey v FROM orders), n AS (SELECT *, lead(v) OVER (PARTITION BY k ORDER BY v) x FROM k)
  SELECT k, v FROM k UNION ALL SELECT k, CAST(round_even((v + x) / 2, 0) AS BIGINT) FROM n WHERE x - v > 100""")
def gap_midpoints(t):
    c = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")).distinct()
    return W.fill_gaps(c, "v", ["k"], 100)


@query("SELECT p_brand, first, row_number() OVER (ORDER BY first) - 1 AS number FROM (SELECT p_brand, min(p_partkey) first FROM part GROUP BY 1)")
def stable_distinct(t):
    return W.first_of(t("part"), ["p_brand"], "p_partkey")


@query("SELECT p_partkey, CASE WHEN l > 0 THEN dense_rank() OVER (PARTITION BY l > 0 ORDER BY l) ELSE 0 END dense FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END l FROM part)")
def dense_relabel(t):
    p = t("part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, 0).otherwise(F.col("p_size")).alias("l"))
    return W.relabel(p, "l").select("p_partkey", "dense")


@query("SELECT k, coalesce(n, 0) n, CAST(coalesce(sum(coalesce(n, 0)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM (SELECT unnest(range(60)) k) LEFT JOIN (SELECT p_size k, count(*) n FROM part GROUP BY 1) USING (k)")
def csr_offsets(t):
    p = t("part").select(F.col("p_size").cast("long").alias("k"))
    return W.offsets(p, "k", p.sparkSession.range(60).withColumnRenamed("id", "k"))


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 3) box FROM lineitem")
def box_sums(t):
    return W.box_sum(t("lineitem"), "l_quantity", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 1).select("l_orderkey", "l_linenumber", r("box", 3).alias("box"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) rn FROM events) WHERE rn = 1")
def last_record_wins(t):
    return W.last_wins(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


FACES = "SELECT l_orderkey * 10 + l_linenumber f, l_partkey % 97 p, l_suppkey % 89 + 100 q, l_orderkey % 83 + 200 s FROM lineitem"


def _faces(t):
    return t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("f"), (F.col("l_partkey") % 97).alias("p"), (F.col("l_suppkey") % 89 + 100).alias("q"), (F.col("l_orderkey") % 83 + 200).alias("s"))


EDGES = f"WITH h AS (SELECT f, unnest([p, q, p]) a, unnest([q, s, s]) b FROM ({FACES})), e AS (SELECT a, b, min(f) face_a, CASE WHEN count(*) > 1 THEN max(f) END face_b, count(*) n_faces FROM h GROUP BY a, b)"


@query(EDGES + " SELECT * FROM e")
def mesh_edges(t):
    return J.edges(_faces(t), ["p", "q", "s"], "f")


@query(EDGES + f", v AS (SELECT f, CAST(p * s AS DOUBLE) x FROM ({FACES})) SELECT a, b, least(v.x, coalesce(w.x, v.x)) low, greatest(v.x, coalesce(w.x, v.x)) high, (v.x + coalesce(w.x, v.x)) / 2 AS mean FROM e JOIN v ON v.f = face_a LEFT JOIN v w ON w.f = face_b")
def edge_gather(t):
    f = _faces(t)
    return J.gather(J.edges(f, ["p", "q", "s"], "f"), f.withColumn("x", (F.col("p") * F.col("s")).cast("double")), "f", "x")


@query("""WITH g AS (SELECT p_partkey id, p_size * 8.0 x, p_retailprice % 400 y, p_size % 20 r FROM part WHERE p_size % 20 > 0)
  SELECT x.t tile_x, y.t tile_y, id FROM g, range(26) x(t), range(26) y(t) WHERE x.t >= greatest(floor((x - r) / 16), 0) AND x.t < least(ceil((x + r) / 16), 26) AND y.t >= greatest(floor((y - r) / 16), 0) AND y.t < least(ceil((y + r) / 16), 26)""")
def tile_intersections(t):
    g = t("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 8.0).alias("x"), (F.col("p_retailprice") % 400).alias("y"), (F.col("p_size") % 20).alias("r"))
    return J.tiles(g, "id", "x", "y", "r", 16, 26, 26)


POINTS = "SELECT p_partkey id, p_retailprice / 10 x, CAST(p_size AS DOUBLE) y FROM part"


def _points(t):
    return t("part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 10).alias("x"), F.col("p_size").cast("double").alias("y"))


@query(f"""WITH p AS ({POINTS}), d AS (SELECT a.id l, b.id r, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) d FROM p a JOIN p b ON a.id % 2 = 0 AND b.id % 2 = 1 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9)
  SELECT l, r, round(d, 4) distance FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY d, r) rn FROM d) WHERE rn = 1""")
def nearest_neighbour(t):
    p = _points(t)
    return J.nearest_within(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), "id", "id", ["x", "y"], 3.0).withColumn("distance", r("distance"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_candidates(t):
    return L.top_k(t("orders"), "o_totalprice", "o_orderkey", 50).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) place FROM orders) WHERE place <= 3")
def top_by_group(t):
    return L.top_k_by(t("orders"), ["o_custkey"], "o_totalprice", "o_orderkey", 3).select("o_custkey", "o_orderkey", "place")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0 ORDER BY c_custkey LIMIT 40")
def systematic_sample(t):
    return L.every(t("customer"), "c_custkey", 10, 40).select("c_custkey")


@query("WITH g AS (SELECT s_suppkey, s_suppkey % 7 part FROM supplier) SELECT * FROM g WHERE part IN (SELECT part FROM g GROUP BY part HAVING count(*) >= 2)")
def interleaved_groups(t):
    return L.groups(t("supplier").select("s_suppkey"), "s_suppkey", 7, 2)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unreferenced_rows(t):
    return L.without_parents(t("customer"), t("orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 new_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def compact_ids(t):
    return L.compact(t("customer"), "c_custkey", t("orders"), "o_custkey").select("c_custkey", "new_id")


@query("SELECT list_sort([l_partkey % 10, l_suppkey % 10, l_orderkey % 10]) members, min(l_orderkey) l_orderkey FROM lineitem GROUP BY 1")
def distinct_member_sets(t):
    x = t("lineitem").select((F.col("l_partkey") % 10).alias("a"), (F.col("l_suppkey") % 10).alias("b"), (F.col("l_orderkey") % 10).alias("c"), "l_orderkey")
    return L.distinct_sets(x, ["a", "b", "c"], "l_orderkey")


@query("SELECT o_orderkey, o_totalprice, NULL::INT child FROM orders WHERE o_totalprice <= 100000 UNION ALL SELECT o_orderkey, o_totalprice / 1.6, c FROM orders, (SELECT unnest([0, 1]) c) WHERE o_totalprice > 100000")
def densify_split(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    return L.split_rows(o, F.col("o_totalprice") > 100000, "o_totalprice", 1.6)


@query("SELECT l_suppkey, l_linenumber, arg_max(o, (l_quantity, -o)) AS owner FROM (SELECT *, l_orderkey * 10 + l_linenumber o FROM lineitem) GROUP BY 1, 2")
def priority_overlay(t):
    x = t("lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return L.overlay(x, ["l_suppkey", "l_linenumber"], "l_quantity", "o")


@query("SELECT s_suppkey, unnest(list_filter([CASE WHEN s_acctbal < 0 THEN 'negative' END, CASE WHEN s_acctbal > 5000 THEN 'large' END, CASE WHEN s_suppkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS rule FROM supplier")
def guard_violations(t):
    s = t("supplier")
    return L.violations(s, {"negative": F.col("s_acctbal") < 0, "large": F.col("s_acctbal") > 5000, "even": F.col("s_suppkey") % 2 == 0}).select("s_suppkey", "rule")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'density' WHEN l_discount > 0.08 THEN 'support' WHEN l_tax > 0.06 THEN 'boundary' ELSE 'accepted' END reason FROM lineitem")
def decision_chain(t):
    c = L.first_reason([("density", F.col("l_quantity") < 5), ("support", F.col("l_discount") > 0.08), ("boundary", F.col("l_tax") > 0.06)], "accepted")
    return t("lineitem").select("l_orderkey", "l_linenumber", c.alias("reason"))


GRAPH = "SELECT DISTINCT o_custkey a, 1000000 + o_orderkey % 4000 b FROM orders"


def _graph(t):
    return t("orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 4000 + 1000000).alias("b")).distinct()


TWO_WAYS = f"g AS MATERIALIZED ({GRAPH}), e AS MATERIALIZED (SELECT a, b FROM g UNION SELECT b, a FROM g)"


@query(f"WITH RECURSIVE {TWO_WAYS}, r(n, m) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a) SELECT n AS node, min(m) AS root FROM r GROUP BY n")
def connected_components(t):
    return G.components(_graph(t))


@query(f"""WITH {TWO_WAYS}, v0 AS (SELECT a n, CAST(a % 100 AS DOUBLE) x FROM (SELECT DISTINCT a FROM e)),
  v1 AS (SELECT n, max(x) x FROM (SELECT * FROM v0 UNION ALL SELECT e.a, x * 0.9 FROM e JOIN v0 ON v0.n = e.b) GROUP BY n),
  v2 AS (SELECT n, max(x) x FROM (SELECT * FROM v1 UNION ALL SELECT e.a, x * 0.9 FROM e JOIN v1 ON v1.n = e.b) GROUP BY n) SELECT n AS node, round(x, 4) x FROM v2""")
def propagate_maximum(t):
    g = _graph(t)
    v = G.both_ways(g).select(F.col("a").alias("node")).distinct().withColumn("x", (F.col("node") % 100).cast("double"))
    return G.propagate_max(v, g, 2, 0.9).withColumn("x", r("x"))


@query(f"""WITH {TWO_WAYS}, v0 AS (SELECT a n, CAST(a % 100 AS DOUBLE) x FROM (SELECT DISTINCT a FROM e)),
  v1 AS (SELECT n, x + 0.4142135623 * (m - x) x FROM v0 JOIN (SELECT e.a, avg(x) m FROM e JOIN v0 ON v0.n = e.b GROUP BY e.a) ON a = n),
  v2 AS (SELECT n, x + 0.4142135623 * (m - x) x FROM v1 JOIN (SELECT e.a, avg(x) m FROM e JOIN v1 ON v1.n = e.b GROUP BY e.a) ON a = n) SELECT n AS node, round(x, 4) x FROM v2""")
def graph_smoothing(t):
    """The strength is no short fraction: with 0.5 some results lie half way between two roundings."""
    g = _graph(t)
    v = G.both_ways(g).select(F.col("a").alias("node")).distinct().withColumn("x", (F.col("node") % 100).cast("double"))
    return G.smooth(v, g, 2, 0.4142135623).withColumn("x", r("x"))


@query(f"""WITH {TWO_WAYS}, s AS (SELECT DISTINCT a o FROM e), x AS (SELECT o, o n, 0 k FROM s UNION ALL SELECT o, e.b, 1 FROM s JOIN e ON e.a = o
  UNION ALL SELECT o, f.b, 2 FROM s JOIN e ON e.a = o JOIN e f ON f.a = e.b) SELECT o origin, n AS node, min(k) ring FROM x GROUP BY ALL""")
def two_rings(t):
    g = _graph(t)
    s = G.both_ways(g).select(F.col("a").alias("node")).distinct()
    return G.rings(g, s, 2)


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN hi > lo THEN round_even((l_extendedprice - lo) / (hi - lo) * 255, 0) ELSE 0 END AS BIGINT) code FROM lineitem, (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem)""")
def min_max_codes(t):
    x = t("lineitem")
    b = x.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    return x.join(F.broadcast(b)).select("l_orderkey", "l_linenumber", S.quantize(F.col("l_extendedprice"), F.col("lo"), F.col("hi"), 8).alias("code"))  # one row


@query("SELECT CAST(floor(x / 10) AS BIGINT) vx, CAST(floor(y / 10) AS BIGINT) vy, count(*) n, min(id) first FROM (" + POINTS + ") GROUP BY 1, 2")
def voxel_groups(t):
    return _points(t).groupBy(F.floor(F.col("x") / 10).alias("vx"), F.floor(F.col("y") / 10).alias("vy")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN ok THEN u ELSE -1 END AS INT) u, CAST(CASE WHEN ok THEN v ELSE -1 END AS INT) v
  FROM (SELECT *, l_discount + 0.5 > 0.51 AND u BETWEEN 0 AND 639 AND v BETWEEN 0 AND 479 ok
    FROM (SELECT l_orderkey, l_linenumber, l_discount, round_even((l_quantity - 25) / 50 / (l_discount + 0.5) * 500 + 320, 0) u, round_even(l_tax * 8 / (l_discount + 0.5) * 500 + 40, 0) v FROM lineitem))""")
def pinhole_projection(t):
    z = F.col("l_discount") + 0.5
    u, v = C.pinhole((F.col("l_quantity") - 25) / 50, F.col("l_tax") * 8, z, 500.0, 500.0, 320.0, 40.0, 640, 480, 0.51)
    return t("lineitem").select("l_orderkey", "l_linenumber", u.alias("u"), v.alias("v"))


@query("""SELECT vec_id, round(0.5 * sqrt(1 / pi()), 4) h0, round(-sqrt(3 / (4 * pi())) * y, 4) h1, round(sqrt(3 / (4 * pi())) * z, 4) h2, round(-sqrt(3 / (4 * pi())) * x, 4) h3,
  round(0.5 * sqrt(15 / pi()) * x * y, 4) h4, round(-0.5 * sqrt(15 / pi()) * y * z, 4) h5, round(0.25 * sqrt(5 / pi()) * (3 * z * z - 1), 4) h6, round(-0.5 * sqrt(15 / pi()) * x * z, 4) h7, round(0.25 * sqrt(15 / pi()) * (x * x - y * y), 4) h8
  FROM (SELECT vec_id, a / n x, b / n y, c / n z FROM (SELECT *, sqrt(a * a + b * b + c * c) n FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) a, CAST(embedding[2] AS DOUBLE) b, CAST(embedding[3] AS DOUBLE) c FROM embeddings)))""")
def spherical_harmonics(t):
    raw = t("embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("abc")])
    n = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    unit = raw.select("vec_id", *[(F.col(c) / n).alias(d) for c, d in zip("abc", "xyz", strict=True)])
    return unit.select("vec_id", *[r(h).alias(f"h{k}") for k, h in enumerate(C.harmonics(F.col("x"), F.col("y"), F.col("z"), 2))])


@query("""WITH q AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) w, CAST(embedding[2] AS DOUBLE) x, CAST(embedding[3] AS DOUBLE) y, CAST(embedding[4] AS DOUBLE) z FROM embeddings),
  m AS (SELECT vec_id, w * w + x * x + y * y + z * z n, w, x, y, z FROM q),
  rot AS (SELECT vec_id, (w*w + x*x - y*y - z*z) / n a, 2 * (x*y - w*z) / n b, 2 * (x*z + w*y) / n c, 2 * (x*y + w*z) / n d, (w*w - x*x + y*y - z*z) / n e, 2 * (y*z - w*x) / n f, 2 * (x*z - w*y) / n g, 2 * (y*z + w*x) / n h, (w*w - x*x - y*y + z*z) / n i FROM m)
  SELECT vec_id, round(a*a + 4*b*b + 9*c*c, 4) xx, round(a*d + 4*b*e + 9*c*f, 4) xy, round(a*g + 4*b*h + 9*c*i, 4) xz, round(d*d + 4*e*e + 9*f*f, 4) yy, round(d*g + 4*e*h + 9*f*i, 4) yz, round(g*g + 4*h*h + 9*i*i, 4) zz FROM rot""")
def quaternion_covariance(t):
    q = t("embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("wxyz")])
    cov = C.covariance([F.col(n) for n in "wxyz"], [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    return q.select("vec_id", *[r(c).alias(n) for c, n in zip(cov, ("xx", "xy", "xz", "yy", "yz", "zz"), strict=True)])


@query("""WITH px AS (SELECT l_linenumber f, l_orderkey % 40 u, l_partkey % 30 v, CAST(count(*) AS DOUBLE) x FROM lineitem GROUP BY ALL),
  g AS (SELECT p.f, p.u, p.v, (coalesce(r.x, 0) - coalesce(l.x, 0)) / 2 gu, (coalesce(d.x, 0) - coalesce(o.x, 0)) / 2 gv FROM px p
    LEFT JOIN px r ON r.f = p.f AND r.u = p.u + 1 AND r.v = p.v LEFT JOIN px l ON l.f = p.f AND l.u = p.u - 1 AND l.v = p.v
    LEFT JOIN px d ON d.f = p.f AND d.u = p.u AND d.v = p.v + 1 LEFT JOIN px o ON o.f = p.f AND o.u = p.u AND o.v = p.v - 1)
  SELECT a.f, a.u, a.v, round(sum(b.gu * b.gu), 4) j11, round(sum(b.gu * b.gv), 4) j12, round(sum(b.gv * b.gv), 4) j22
  FROM g a JOIN g b ON a.f = b.f AND b.u BETWEEN a.u - 1 AND a.u + 1 AND b.v BETWEEN a.v - 1 AND a.v + 1 GROUP BY ALL""")
def structure_tensors(t):
    px = t("lineitem").groupBy(F.col("l_linenumber").alias("f"), (F.col("l_orderkey") % 40).alias("u"), (F.col("l_partkey") % 30).alias("v")).agg(F.count("*").cast("double").alias("x"))
    return R.structure_tensor(px, ["f"], "x").select("f", "u", "v", r(F.col("j11")).alias("j11"), r(F.col("j12")).alias("j12"), r(F.col("j22")).alias("j22"))


def _k_means_sql(k: int, rounds: int) -> str:
    nearest = "SELECT id, x, y, arg_min(k, (d, k)) k FROM (SELECT p.*, k, (p.x - cx) ** 2 + (p.y - cy) ** 2 d FROM p, c{0}) GROUP BY ALL"
    out = f"WITH p AS ({POINTS}), c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 k, x cx, y cy FROM p ORDER BY id LIMIT {k})"
    for n in range(rounds):
        out += f", a{n} AS ({nearest.format(n)}), c{n + 1} AS (SELECT c.k, coalesce(m.x, cx) cx, coalesce(m.y, cy) cy FROM c{n} c LEFT JOIN (SELECT k, avg(x) x, avg(y) y FROM a{n} GROUP BY k) m USING (k))"
    return out + f" SELECT id, CAST(k AS INT) AS cluster FROM ({nearest.format(rounds)})"


@query(_k_means_sql(4, 2))
def k_means_codebook(t):
    return K.k_means(_points(t), "id", ["x", "y"], 4, 2)[0].select("id", "cluster")


def _mixture_sql(rounds: int) -> str:
    out = """WITH v AS (SELECT o_totalprice / 1000 x, 1.0 + o_custkey % 3 w FROM orders),
  m0 AS (SELECT 0.55 pa, quantile_cont(x, 0.3) ma, greatest(stddev_pop(x), 1e-6) sa, 0.45 pb, quantile_cont(x, 0.8) mb, greatest(stddev_pop(x), 1e-6) sb FROM v)"""
    for n in range(rounds):
        out += f""", r{n} AS (SELECT x, w * a / (a + b) a, w * b / (a + b) b FROM (SELECT x, w, pa / sa * exp(-0.5 * ((x - ma) / sa) ** 2) a, pb / sb * exp(-0.5 * ((x - mb) / sb) ** 2) b FROM v, m{n})),
  m{n + 1} AS (SELECT sum(a) / (sum(a) + sum(b)) pa, sum(a * x) / sum(a) ma, sqrt(sum(a * x * x) / sum(a) - (sum(a * x) / sum(a)) ** 2) sa, sum(b) / (sum(a) + sum(b)) pb, sum(b * x) / sum(b) mb, sqrt(sum(b * x * x) / sum(b) - (sum(b * x) / sum(b)) ** 2) sb FROM r{n})"""
    return out + f" SELECT round(pa, 4) share0, round(ma, 3) mean0, round(sa, 3) sd0, round(pb, 4) share1, round(mb, 3) mean1, round(sb, 3) sd1 FROM m{rounds}"


@query(_mixture_sql(3))
def gaussian_mixture(t):
    o = t("orders").select((F.col("o_totalprice") / 1000).alias("x"), (F.lit(1.0) + F.col("o_custkey") % 3).alias("w"))
    m = K.two_gaussians(o, "x", "w", 3)
    names = [n + k for k in "01" for n in ("share", "mean", "sd")]
    rows = [tuple(round(m[n], 4 if n[0:2] == "sh" else 3) for n in names)] if m else []
    return o.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


@query(f"""WITH RECURSIVE p AS ({POINTS}), l AS MATERIALIZED (SELECT a.id a, b.id b FROM p a JOIN p b ON a.id <> b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 2.25), c AS MATERIALIZED (SELECT a id FROM l GROUP BY a HAVING count(*) >= 3),
  e AS MATERIALIZED (SELECT a, b FROM l WHERE a IN (FROM c) AND b IN (FROM c)), r(n, m) AS (SELECT id, id FROM c UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a), k AS (SELECT n id, min(m) AS cluster FROM r GROUP BY n)
  SELECT * FROM k UNION ALL SELECT b, min(cluster) FROM l JOIN k ON k.id = l.a WHERE b NOT IN (FROM c) GROUP BY b""")
def density_clusters(t):
    return K.density_clusters_within(_points(t), "id", ["x", "y"], 1.5, 4)


@query()
def merged_components(t):
    o = t("orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 500 + 1000000).alias("b"), (F.col("o_totalprice") / 300000).alias("score"), F.lit(1.0).alias("confidence"))
    return K.merge_components(o, [0.95, 0.9, 0.8], 1.0)


@query()
def greedy_matching(t):
    return G.greedy_matching(t("orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 4000 + 1000000).alias("b"), F.col("o_totalprice").alias("rank")))


@query("""WITH p AS (SELECT l_linenumber g, l_quantity x, l_discount * 100 y, l_tax * 100 z, l_extendedprice / 1000 w FROM lineitem),
  c AS (SELECT g, count(*) n, sum(w) weight, sum(w * x) / sum(w) cx, sum(w * y) / sum(w) cy, sum(w * z) / sum(w) cz FROM p GROUP BY g),
  m AS (SELECT g, n, weight, cx, cy, cz, sum(w * (x - cx) ** 2) / weight a, sum(w * (y - cy) ** 2) / weight b, sum(w * (z - cz) ** 2) / weight c, sum(w * (x - cx) * (y - cy)) / weight d, sum(w * (x - cx) * (z - cz)) / weight e, sum(w * (y - cy) * (z - cz)) / weight f FROM p JOIN c USING (g) GROUP BY g, n, weight, cx, cy, cz),
  q AS (SELECT *, (a + b + c) / 3 q FROM m), s AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) s FROM q),
  h AS (SELECT *, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / s ** 3 / 2 h FROM s)
  SELECT g, n, round(weight, 2) weight, round(cx, 4) cx, round(cy, 4) cy, round(cz, 4) cz, round(q + 2 * s * cos(acos(least(greatest(h, -1), 1)) / 3 + 2 * pi() / 3), 4) variance FROM h""")
def plane_fit(t):
    p = t("lineitem").select(F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"), (F.col("l_extendedprice") / 1000).alias("w"))
    f = P.fit(p, ["g"], "w")
    return f.select("g", "n", r("weight", 2).alias("weight"), *[r(c).alias(c) for c in ("cx", "cy", "cz", "variance")])


@query("""SELECT c_custkey FROM customer WHERE c_acctbal > 0
  ORDER BY -ln((CAST('0x' || substr(md5('7:' || c_custkey), 1, 8) AS BIGINT) + 0.5) / 4294967296.0) / c_acctbal, c_custkey LIMIT 60""")
def weighted_sample(t):
    return L.weighted_sample(t("customer"), "c_custkey", "c_acctbal", 60, 7).select("c_custkey")


@query("SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) n FROM supplier) WHERE n > 5")
def crop_lowest(t):
    return L.without_lowest(t("supplier"), "s_acctbal", "s_suppkey", 5).select("s_suppkey")


@query("SELECT c_custkey, CAST(coalesce(label, c_nationkey) AS INT) AS label FROM customer LEFT JOIN (SELECT o_custkey c_custkey, arg_max(o_orderkey % 9, o_orderkey) AS label FROM orders GROUP BY 1) USING (c_custkey)")
def label_edit_replay(t):
    edits = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("step"), (F.col("o_orderkey") % 9).alias("label"))
    return L.replay(t("customer").select("c_custkey", F.col("c_nationkey").alias("label")), edits, "c_custkey").withColumn("label", F.col("label").cast("int"))


@query("""WITH s AS (SELECT user_id, event_id, value b, coalesce(lag(value) OVER w, value) a, lead(value) OVER w c, coalesce(lead(value, 2) OVER w, lead(value) OVER w) d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  x AS (SELECT *, unnest(CASE WHEN c IS NULL THEN [0] ELSE [0, 1, 2] END) part FROM s)
  SELECT user_id, event_id, part, round(CASE WHEN part = 0 THEN b ELSE (2 * b + (c - a) * (part / 3) + (2 * a - 5 * b + 4 * c - d) * (part / 3) ** 2 + (3 * b - a - 3 * c + d) * (part / 3) ** 3) / 2 END, 4) AS value FROM x""")
def interpolated_path(t):
    return W.interpolate(t("events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "value", 3).withColumn("value", r("value"))
