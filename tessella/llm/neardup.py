"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists of retained values, exact Jaccard.

1. A document's set holds the hashes of its distinct word shingles. Equal sets are merged: only the smallest doc_id of
   each goes on.
2. Its sketch is the `K` smallest hashes, in order. The inverted lists hold runs of two neighbouring retained values:
   two sets of similarity 0.8 share one but for a chance of 0.512 ** K. A list of more than `SHORT` documents is split
   by the next retained value, and again, up to runs of `LONGEST` values; so a line or passage that many unlike
   documents hold yields few pairs of its own. Sets of up to `SMALL` shingles also get lists of the set, of the set
   without one, and without two shingles, which find every pair exactly, whatever the lists above do.
3. Short lists emit their pairs, and the long lists of `SURE` values or more, split or not, emit one pair for each
   member, with the smallest member. If after those pairs are verified a long list still holds several components, all its members
   are joined exactly, by prefix filtering of their whole sets from the rarest shingle on, and only across components.
   So no pair that shares a run of `SURE` values is parted by a split: all pairs of sets of up to `K`.
4. The union of two sketches estimates the similarity; pairs under the threshold by more than `MARGIN` (over six
   standard deviations) go, and the exact similarity of whole sets decides on the rest.
5. Links give connected components.

Defined results: null and wordless texts have the empty set and link with nothing; fewer words than a shingle make one
shingle of the whole; repeated rows and equal texts fall in one component; ties go to the smallest doc_id. Rows with a
null doc_id can't be named: they link with nothing, have no component_id, and are kept. Of different texts under one
doc_id the one of the most shingles (then by fingerprint) stands for it in links. An empty table gives no rows; a text
is shingled whole, in memory linear in the longest; columns but doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, Powers, mix, stage, texts
from .components import components

K, SHORT, LONGEST, SMALL, MARGIN = 64, 8, 5, 14, 0.3
#: Two sets of over SMALL and up to K shingles and similarity 0.8 share a run of so many values: of u in the union, at
#: most u / 5 part the others into u / 5 + 1 runs.
SURE = 3
BASE = 0xC2B2AE3D27D4EB4F
SETS = "doc_id long, n long, f1 long, f2 long, sketch array<long>, small array<struct<key:long,role:int>>"


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, size: int):
        self.size, self.hashes, self.powers = size, Hashes(), Powers(BASE)

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.int64)
        h = self.hashes.of(words)
        n = min(self.size, len(words))
        return np.unique((self.powers.windows(h, n) + np.uint64(n if n < self.size else 0)).view(np.int64))


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    u = s.view(np.uint64)
    return int(mix(u).sum().view(np.int64)), int(mix(u ^ np.uint64(BASE)).sum().view(np.int64))


def _less(s: np.ndarray) -> list[dict]:
    """Keys of a small set, and of the set without one or two of its members; fingerprints are sums."""
    u = mix(s.view(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    with np.errstate(over="ignore"):
        total = u.sum() + np.uint64(len(s))
        out = [(total, 0)]
        if len(s) > 4:
            out += [(total - x - np.uint64(1), 1) for x in u]
        if len(s) >= 10:
            out += [(total - x - y - np.uint64(2), 2) for x, y in combinations(u, 2)]
    return [{"key": int(k.view(np.int64)), "role": r} for k, r in out]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, pa.int64()))


def _sets(size: int):
    def run(it):
        shingler = Shingler(size)
        pair = pa.list_(pa.struct([("key", pa.int64()), ("role", pa.int32())]))
        for batch in it:
            sets = [shingler.of(t) for t in texts(batch)]
            marks = np.array([_fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
            small = [_less(s) if 0 < len(s) <= SMALL else [] for s in sets]
            columns = [batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), _lists([s[:K] for s in sets]), pa.array(small, pair)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "f1", "f2", "sketch", "small"])

    return run


def _pairs(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of the short lists and of the small sets; and the members (key, doc_id) of the long lists of SURE values or more."""
    found, left = [], []
    size = F.size("sketch")
    at = F.explode(F.sequence(F.lit(1), size - 1))
    runs = reps.filter(size > 1).select("doc_id", "sketch", at.alias("i"))
    for length in range(2, LONGEST + 1):
        keyed = runs.select("doc_id", "i", F.xxhash64(F.slice("sketch", F.col("i"), F.lit(length))).alias("key"))
        lists = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        keyed = stage(keyed.join(lists.hint("shuffle_hash"), "key"), f"runs-{length}")
        short = keyed.filter(F.col("members") <= SHORT).select("key", "doc_id")
        found.append(short.join(short.withColumnRenamed("doc_id", "other"), "key").filter("doc_id < other").select(*_pairs("doc_id", "other")))
        long = keyed.filter(F.col("members") > SHORT)
        if length >= SURE:
            left.append(long.select("key", "doc_id"))
        if length == LONGEST or not long.limit(1).count():
            left = left or [long.select("key", "doc_id")]
            break
        more = long.join(reps.select("doc_id", "sketch"), "doc_id")
        runs = more.filter(F.col("i") + length <= size).select("doc_id", "sketch", "i")
    own = reps.select("doc_id", F.explode("small").alias("s")).select("doc_id", "s.*")
    lead = own.groupBy("key").agg(F.min(F.struct("role", "doc_id")).alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("key", F.col("lead.doc_id").alias("first"))
    found.append(own.join(lead.hint("shuffle_hash"), "key").filter("doc_id <> first").select(*_pairs("doc_id", "first")))
    pairs, lists = found[0], left[0]
    for p in found[1:]:
        pairs = pairs.union(p)
    for x in left[1:]:
        lists = lists.union(x)
    return pairs, lists


def _estimate(sketches: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose union sketch doesn't speak against them. Sketches that hold whole sets decide exactly."""
    s = lambda p: sketches.select(F.col("doc_id").alias(p), F.col("sketch").alias("s" + p), F.col("n").alias("n" + p))
    j = pairs.distinct().join(s("a"), "a").join(s("b"), "b")
    fits = F.least("na", "nb") >= threshold * F.greatest("na", "nb")
    union = F.array_sort(F.array_union("sa", "sb"))
    seen = F.when(F.greatest("na", "nb") <= K, union).otherwise(F.slice(union, 1, K))
    both = F.size(F.array_intersect(seen, F.array_intersect("sa", "sb")))
    return j.filter(fits).filter(both >= F.when(F.greatest("na", "nb") <= K, F.lit(threshold)).otherwise(threshold - MARGIN) * F.size(seen) - 1e-9).select("a", "b")


def verify(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their whole sets; staged."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def sets(it):
        shingler = Shingler(size)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingler.of(t).tobytes() for t in texts(batch)], pa.binary())], names=["doc_id", "items"])

    whole = docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, "doc_id long, items binary")
    whole = stage(whole, "sets")

    def decide(it):
        for batch in it:
            fine = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(fine, pa.bool_()))

    j = pairs.join(whole.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(whole.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    return stage(j.select("a", "b", "x", "y").mapInArrow(decide, "a long, b long"), "links")


def links(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(membership: doc_id, n, rep; links: a, b between representatives of equal sets)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stage(docs.mapInArrow(_sets(size), SETS), "sets")
    same = ["n", "f1", "f2"]
    reps = sets.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    member = stage(sets.select("doc_id", *same).join(reps, same, "left").select("doc_id", *same, F.coalesce("rep", "doc_id").alias("rep")), "members")
    only = member.filter("doc_id = rep and n > 0").groupBy("doc_id").agg(F.max(F.struct(*same)).alias("k")).select("doc_id", "k.*")
    reps = stage(sets.join(only, ["doc_id", *same], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "sketch", "small"), "reps")
    pairs, long = candidates(reps)
    sketches = reps.select("doc_id", "n", "sketch")
    docs = docs.filter("doc_id is not null")
    return member, _verified(docs, sketches, pairs, stage(long, "long-lists"), size, percent)


def _verified(docs: DataFrame, sketches: DataFrame, pairs: DataFrame, long: DataFrame, size: int, percent: int) -> DataFrame:
    first = long.groupBy("key").agg(F.min("doc_id").alias("first"))
    star = long.join(first.hint("shuffle_hash"), "key").filter("doc_id <> first").select(*_pairs("doc_id", "first"))
    edges = verify(docs, stage(_estimate(sketches, pairs.union(star), percent / 100), "pairs"), size, percent)
    root = components(edges)
    named = long.join(root.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    open_ = stage(named.join(mixed.hint("shuffle_hash"), "key").select("doc_id", "root").distinct(), "open")
    if not open_.limit(1).count():
        return edges
    return edges.union(verify(docs, stage(_by_rarity(docs, open_, size, percent), "pairs"), size, percent))


def _by_rarity(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Every pair of members (doc_id, root) of different roots that can reach the similarity, by prefix filtering:
    each whole set is put in order of how few members hold a shingle. Two sets that are similar enough share one of
    the first n - need + 1 shingles of both, and what comes after the first shared one bounds their intersection. In
    each list, the members outside its largest component are compared with the others."""

    def sets(it):
        shingler = Shingler(size)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("root"), _lists([shingler.of(t) for t in texts(batch)])], names=["doc_id", "root", "items"])

    whole = stage(docs.join(members.hint("shuffle_hash"), "doc_id").select("doc_id", "root", "text").mapInArrow(sets, "doc_id long, root long, items array<long>"), "open-sets")
    item = whole.select("doc_id", "root", F.explode("items").alias("v"))
    # tables of their own, so that the joins below have plain exchanges, whose hot keys AQE can split
    held = stage(item.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequent")
    order = item.join(held, "v", "left").groupBy("doc_id", "root").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "v"))).alias("order"))
    n = F.size("order")
    order = order.select("doc_id", "root", n.alias("n"), F.posexplode(F.slice("order", F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int"))).alias("i", "e"))
    posting = stage(order.filter("e.df > 1").select("doc_id", "root", "n", "i", F.col("e.v").alias("v")), "postings")
    count = posting.groupBy("v", "root").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    lists = count.groupBy("v").agg(F.min("n").alias("least"), F.max(F.struct("c", F.negative("root").alias("neg"))).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    posting = posting.join(stage(lists.select("v", "least", F.negative("most.neg").alias("main")), "open-lists"), "v")
    left = F.col("n") - F.col("i")  # no more than these are shared if v is the first shared one
    posting = posting.filter(100 * left >= percent * (F.col("n") + F.greatest("least", left) - left))
    x, y = posting.filter("root <> main").alias("x"), posting.alias("y")
    both = F.least(F.expr("x.n - x.i"), F.expr("y.n - y.i"))
    fits = F.expr("x.v = y.v and x.root <> y.root and (y.root = y.main or x.doc_id < y.doc_id)") & (100 * both >= percent * (F.col("x.n") + F.col("y.n") - both))
    return x.join(y, fits).select(*_pairs("x.doc_id", "y.doc_id")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id is the smallest of its component) of every document."""
    member, edges = links(docs, size, percent)
    root = components(edges)
    out = member.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its columns; repeated rows of it stay.
    Rows with a null doc_id can't be told apart and stay."""
    gone = near_duplicates(docs, size, percent).filter("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
