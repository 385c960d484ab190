"""Hard negatives by inner products of integer vectors, with an orthogonal PCA rotation to discard early.

All rows lie in blocks by their id's hash, as many as there are shuffle partitions or more, of `CELLS` components at
most; a task holds one block. Anchors are the stated query set: a copy of each goes to every block and streams past it,
some at a time. An anchor and a row first meet with their leading principal components only: what is left of their
product is at most the product of their residual norms, and a slack covers all rounding, so the sum bounds the exact
score from above and below. A pair whose bounds can't reach what the anchor still looks for is discarded; the others
add more components, and the survivors of the last level are scored with integers. Bounds decide no result: any
orthogonal matrix gives the same rows.

The first pass finds each anchor's positives, the second one the negatives of each positive; both send the first few of
each block to a ranked window. Of equal vectors with equal labels in a block only the first `positives` + 1 or
`negatives` by id are looked at, as no result can hold more of them; so one vector that fills a third of the table
costs a few rows for each block.

Defined results: a null vec_id, label or vector, and a null or non-finite component leave a row out; a vec_id names a
row: of rows that share one, the first by (label, vector) counts; shorter vectors count as padded with zeros; a
positive with a negative score has no negatives; an anchor without positives, or a positive without negatives, has no
rows; ties go to the smaller id; an empty table gives no rows; other columns are not read. Scores must fit a long:
where the largest components of two rows could make them too large, the query fails instead of wrapping around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS, ANCHORS, CHUNK, VERIFIED = 4_000_000, 512, 2048, 50_000
LOWEST = np.iinfo(np.int64).min
ROWS = "kind int, vec_id long, label long, vector array<long>, positives array<struct<score: long, id: long>>"


def integers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if the vector is null or has a null or non-finite component."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale)))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists as the rows of a matrix, padded with zeros."""
    flat, cuts = np.asarray(vectors.flatten()), np.asarray(vectors.offsets).astype(np.int64)
    sizes = np.diff(cuts)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(cuts[:-1] - cuts[0], sizes)] = flat
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Principal directions of all rows' unit vectors about the origin, the leading one first: a sum of products for
    each pair of components, added up by Spark. The driver gets width**2 / 2 numbers."""
    i, j = np.triu_indices(width)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            v = matrix(b.column(0), width).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)
            total += v.T @ v
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "x": total[i, j]})

    got = rows.select("vector").mapInArrow(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    second = np.zeros((width, width))
    second[np.asarray(got["i"]), np.asarray(got["j"])] = np.asarray(got["x"])
    second = second + np.triu(second, 1).T
    return np.ascontiguousarray(np.linalg.eigh(second)[1][:, ::-1])


class Turned:
    """Vectors, rotated: their leading components, and the norms of what is left after each level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, turn: np.ndarray, levels: list[int]):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        plain = vectors.astype(np.float64)
        self.norm = np.linalg.norm(plain, axis=1)
        self.lead = plain @ turn
        self.rest = [np.linalg.norm(self.lead[:, k:], axis=1) for k in levels]
        self.largest = int(np.abs(vectors).max(initial=0))


class Search:
    """Bounds and exact scores of a batch of anchors against parts of a block."""

    def __init__(self, turn: np.ndarray, levels: list[int]):
        self.turn, self.levels = turn, levels
        d, u = len(turn), np.finfo(np.float64).eps
        # the turn is orthogonal but for this, and these are the usual bounds of rounding in products of length d
        self.slack = float(np.linalg.norm(turn @ turn.T - np.eye(d))) + u * (4 * d**1.5 + 8 * d + 2 * d**2)

    def pairs(self, a: Turned, own: np.ndarray, b: Turned, lo: int, hi: int, reach: np.ndarray, cap: np.ndarray, fits) -> tuple[np.ndarray, ...]:
        """Anchors (places in a, of own) and rows lo..hi of b that fit, whose score may lie in reach..cap of the
        anchor, with their exact scores."""
        k = self.levels[0]
        part = a.lead[own, :k] @ b.lead[lo:hi, :k].T
        room = a.rest[0][own, None] * b.rest[0][None, lo:hi] * (1 + 1e-12) + self.slack * a.norm[own, None] * b.norm[None, lo:hi]
        x, y = np.nonzero((part + room >= reach[own, None]) & (part - room <= cap[own, None]) & fits(a, own, b, lo, hi))
        part, i, j = part[x, y], own[x], lo + y
        for n, (k, to) in enumerate(zip(self.levels, self.levels[1:], strict=False), 1):
            if not len(i):
                break
            for at in range(0, len(i), VERIFIED):
                s = slice(at, at + VERIFIED)
                part[s] += np.einsum("nk,nk->n", a.lead[i[s], k:to], b.lead[j[s], k:to])
            room = a.rest[n][i] * b.rest[n][j] * (1 + 1e-12) + self.slack * a.norm[i] * b.norm[j]
            keep = (part + room >= reach[i]) & (part - room <= cap[i])
            part, i, j = part[keep], i[keep], j[keep]
        score = np.empty(len(i), np.int64)
        for at in range(0, len(i), VERIFIED):
            s = slice(at, at + VERIFIED)
            score[s] = np.einsum("nk,nk->n", a.vectors[i[s]], b.vectors[j[s]])
        return i, j, score


class Best:
    """The first few (score, id) of every slot, higher scores and then smaller ids first."""

    def __init__(self, slots: int, size: int):
        self.score, self.id = np.full((slots, size), LOWEST), np.zeros((slots, size), np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.unique(slot)
        n = self.score.shape[1]
        slot = np.concatenate((np.repeat(touched, n), slot))
        score, ids = np.concatenate((self.score[touched].ravel(), score)), np.concatenate((self.id[touched].ravel(), ids))
        order = np.lexsort((ids, ~score, slot))  # ~ turns the order around, and can not overflow
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, touched)
        at = first[:, None] + np.arange(n)
        self.score[touched], self.id[touched] = score[at], ids[at]


def few_of_equal(labels: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` rows of each group of equal labels and vectors, in order."""
    whole = np.ascontiguousarray(np.column_stack((labels, vectors)))
    _, group = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    start = np.searchsorted(group[order], np.arange(group.max() + 1)) if len(group) else np.zeros(0, int)
    return np.sort(order[np.arange(len(order)) - start[group[order]] < most])


def chunks(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Ranges that grow, so that few pairs are scored before there is something to compare with."""
    size = 32
    while lo < hi:
        yield lo, min(hi, lo + size)
        lo, size = lo + size, min(CHUNK, 2 * size)


def _blocks(rows: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """In each of n partitions the rows of one block and then all anchors."""
    none = F.lit(None).cast("array<struct<score: long, id: long>>")
    left = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "vector", none.alias("positives"))
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "label", "vector", "positives")
    return left.union(right).repartitionById(n, "block").sortWithinPartitions("kind", "vec_id", "label", "vector").drop("block")


def _streams(batches: Iterator[pa.RecordBatch], width: int, turn: np.ndarray, levels: list[int], most: int) -> Iterator[tuple[Turned, Turned, list]]:
    """The block, and some anchors at a time with their lists of positives."""
    held: list[tuple[np.ndarray, ...]] = []
    block = None
    for b in batches:
        kind = np.asarray(b.column("kind"))
        n = int(np.searchsorted(kind, 1))
        if n:
            r = b.slice(0, n)
            held.append((np.asarray(r.column("vec_id")), np.asarray(r.column("label")), matrix(r.column("vector"), width)))
        if n < b.num_rows and block is None:
            if held:
                ids, labels, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                new = np.concatenate(([True], ids[1:] != ids[:-1]))
                ids, labels, vectors = ids[new], labels[new], vectors[new]
                few = few_of_equal(labels, vectors, most)
                ids, labels, vectors = ids[few], labels[few], vectors[few]
                order = np.lexsort((-(vectors.astype(np.float64) ** 2).sum(1), labels))
                held = [(ids[order], labels[order], vectors[order])]
            block = Turned(*held[0], turn, levels) if held else False
        if block:
            for at in range(n, b.num_rows, ANCHORS):
                r = b.slice(at, ANCHORS)
                a = Turned(np.asarray(r.column("vec_id")), np.asarray(r.column("label")), matrix(r.column("vector"), width), turn, levels)
                if width * a.largest * block.largest >= 1 << 62:
                    raise ValueError("components are too large for scores of 64 bits")
                yield block, a, r.column("positives").to_pylist()


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float64), -np.inf)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float64), np.inf)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, cells: int = CELLS) -> DataFrame:
    """For each row with `anchor` true and each of its first `positives` other rows of the same label, the first
    `negatives` rows of other labels whose score is low to high percent of the positive's. rows: vec_id long, label
    long, vector array<long>, anchor boolean."""
    rows = rows.select("vec_id", "label", "vector", "anchor").dropna(subset=["vec_id", "label", "vector"])
    count, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = max(1, width or 0)
    turn = rotation(rows, width)
    levels = sorted({max(1, width // 8), max(1, width // 4), max(1, width // 2)})
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * count * width // cells))
    # the anchors among rows that share an id are dealt with here, the others in their block
    named = rows.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")

    def same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(turn, levels)
        for block, a, _ in _streams(batches, width, turn, levels, positives + 1):
            best = Best(len(a.ids), positives)
            cap = np.full(len(a.ids), np.inf)
            for label in np.unique(a.labels):
                own = np.flatnonzero(a.labels == label)
                for lo, hi in chunks(np.searchsorted(block.labels, label), np.searchsorted(block.labels, label, "right")):
                    i, j, score = search.pairs(a, own, block, lo, hi, _below(best.score[:, -1]), cap, lambda a, own, b, lo, hi: a.ids[own, None] != b.ids[None, lo:hi])
                    best.add(i, score, block.ids[j])
            i, k = np.nonzero(best.score != LOWEST)
            yield pa.RecordBatch.from_pydict({"anchor_id": a.ids[i], "id": best.id[i, k], "score": best.score[i, k]})

    none = F.lit(None).cast("array<struct<score: long, id: long>>")
    near = _blocks(rows, named.withColumn("positives", none), parts).mapInArrow(same_label, "anchor_id long, id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    first = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives)
    lists = first.groupBy("anchor_id").agg(F.collect_list(F.struct("score", "id")).alias("positives"))
    armed = named.join(lists, named.vec_id == lists.anchor_id).select("vec_id", "label", "vector", "positives")

    def other_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(turn, levels)
        for block, a, lists in _streams(batches, width, turn, levels, negatives):
            score = np.array([[p["score"] for p in x] + [-1] * (positives - len(x)) for x in lists], np.int64)
            ids = np.array([[p["id"] for p in x] + [0] * (positives - len(x)) for x in lists], np.int64)
            least, most = -(-low * score // 100), high * score // 100
            least[score < 0], most[score < 0] = np.iinfo(np.int64).max, LOWEST
            best = Best(score.size, negatives)
            cap, own = _above(most.max(1)), np.arange(len(a.ids))
            for lo, hi in chunks(0, len(block.ids)):
                wanted = np.maximum(least, best.score[:, -1].reshape(score.shape))
                i, j, s = search.pairs(a, own, block, lo, hi, _below(wanted.min(1)), cap, lambda a, own, b, lo, hi: a.labels[own, None] != b.labels[None, lo:hi])
                n, slot = np.nonzero((s[:, None] >= wanted[i]) & (s[:, None] <= most[i]))
                best.add(i[n] * positives + slot, s[n], block.ids[j[n]])
            n, k = np.nonzero(best.score != LOWEST)
            i, slot = n // positives, n % positives
            yield pa.RecordBatch.from_pydict({"anchor_id": a.ids[i], "positive_id": ids[i, slot], "negative_id": best.id[n, k], "positive_score": score[i, slot], "negative_score": best.score[n, k]})

    found = _blocks(rows, armed, parts).mapInArrow(other_labels, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
