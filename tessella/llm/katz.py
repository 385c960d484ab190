"""LM scoring with a Katz backoff model of words and pairs of words.

Training counts words, and pairs of a word and the token before it (the end token stands before the first word), over
all training documents. Counts up to `K` are discounted by Good-Turing, pairs seen once included. A context's backoff
weight is what its seen pairs leave, divided by what their words leave in the word model, so that every context sums to
one over all seen words and one unknown type, which has what the discounted words leave. A context of count n whose
pairs leave nothing, all being frequent, gives up 1 / (n + 1).

Pairs are counted in buckets of their contexts, so that a context's sums need no join. The at most `HOT` most frequent
words go to all tasks with their counts: pairs with such a context are spread over all buckets, and their sums come
together by context; the probability of a pair's word is known on the spot if the word is one of these, and comes by a
join of rows only if it is not. The tables are Parquet, by bucket: packed pairs, and packed words.

A token's probability is that of its pair if the pair has one, else the context's weight times the word's. So a text's
score is a sum over its words of log P(word) + log weight(word), each word being a context once, plus, over the pairs
that were seen, log P(pair) - log weight - log P(word). Each task sums its documents' keys, resolves the most frequent
words and pairs, at most `HOT` of either, by a broadcast table, and sends the rest packed by bucket; a bucket looks them
up in its part of the tables, and sends sums back packed by parts of the documents. A frequent key so costs nothing
beyond its own task, and no bucket holds more than its share. Keys meet inside a bucket by 48 bits, and what a packed
pair adds is kept to 7 digits.

Defined results: null and empty texts consist of the end token; repeated rows count as often as they come in training,
and are scored alike; rows with a null doc_id train, and are scored; without training documents every token is of the
unknown type; an empty table gives no rows; columns but doc_id and text are not read; a text is hashed whole, in
memory linear in the longest.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, bucket_count, by_bucket, mix, stage, stage_by, texts, unstage

K, HOT, FLUSH, PER_BUCKET, MOST_DOCS, PACK = 5, 50_000, 400_000, 1_000_000, 60_000, 1 << 16
#: Not a word: it holds a space.
END = Hashes()[b" end"]
TOPS = np.uint64(0xFFFFFFFFFFFF)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(word))


def _tokens(text: bytes, hashes: Hashes) -> np.ndarray:
    w = text.lower().split()
    w.append(b" end")
    return hashes.of(w)


def _chunks(it, keep):
    """Lists of (row number, doc_id, tokens) of up to FLUSH tokens."""
    hashes, held, size, row = Hashes(most=200_000), [], 0, 0
    for batch in it:
        for d, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            if keep(d):
                held.append((row, d, _tokens(t, hashes)))
                size += len(held[-1][2])
            row += 1
            if size >= FLUSH or len(held) >= MOST_DOCS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _before(w: np.ndarray, sizes: list[int]) -> np.ndarray:
    b = np.empty_like(w)
    b[1:] = w[:-1]
    b[np.cumsum([0, *sizes[:-1]])] = END
    return b


def _counted(key: np.ndarray, with_order: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the place of one of each, and how often they are there; and an order that sorts them."""
    order = np.argsort(key)  # not the stable one, which takes longer
    new = key[order]
    first = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1])))[: len(key)]
    out = new[first], order[first], np.diff(np.append(first, len(key)))
    return (*out, order) if with_order else out


def words(docs: DataFrame) -> DataFrame:
    """(w, c): the training tokens' counts; staged."""

    def run(it):
        for held in _chunks(it, lambda d: not held_out(d)):
            w, c = np.unique(np.concatenate([t for *_, t in held]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["w", "c"])

    return stage(docs.mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "katz-words")


class Hot:
    """The most frequent words: sorted hashes and their counts."""

    def __init__(self, words: DataFrame):
        rows = most_frequent(words, "c", HOT)
        order = np.argsort(np.array([r.w for r in rows], np.int64).view(np.uint64)) if rows else np.zeros(0, np.int64)
        self.w = np.array([r.w for r in rows], np.int64).view(np.uint64)[order]
        self.c = np.array([r.c for r in rows], np.int64)[order]

    def find(self, w: np.ndarray) -> np.ndarray:
        """Places of words; -1 for others."""
        if not len(self.w):
            return np.full(len(w), -1)
        at = np.minimum(np.searchsorted(self.w, w), len(self.w) - 1)
        return np.where(self.w[at] == w, at, -1)

    def home(self, v: np.ndarray, key: np.ndarray, buckets: int) -> np.ndarray:
        """The buckets of pairs: by context, those of a frequent one by pair."""
        return np.where(self.find(v) >= 0, key, mix(v)).view(np.int64) % buckets


def _step(c: str):
    return F.floor(F.log2(F.col(c).cast("double")) * 16)


def most_frequent(df: DataFrame, c: str, most: int) -> list:
    """The rows of the highest counts, up to `most`, whole steps of a sixteenth of a doubling; a histogram of these
    steps, some hundred rows at most, says from which count on."""
    least, met = None, 0
    for b, k in sorted(df.groupBy(_step(c).alias("b")).count().collect(), reverse=True):
        met += k
        if met > most:
            break
        least = b
    return df.filter(_step(c) >= least).collect() if least is not None else []


def _packs(*columns: np.ndarray) -> list[bytes]:
    """Columns one after another, PACK rows at a time, so that no row of a table is large; at least one pack."""
    return [b"".join(c[k : k + PACK].tobytes() for c in columns) for k in range(0, max(len(columns[0]), 1), PACK)]


def _halves(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 48 bits of keys by which they meet."""
    return (key >> np.uint64(32)).astype(np.uint16), key.astype(np.uint32)


def _unpack(blobs: list[bytes], *types) -> list[np.ndarray]:
    """Columns that were packed one after another, of all blobs."""
    sizes = [np.dtype(t).itemsize for t in types]
    out: list[list] = [[] for _ in types]
    for b in blobs:
        n, at = len(b) // sum(sizes), 0
        for o, t, size in zip(out, types, sizes, strict=True):
            o.append(np.frombuffer(b, t, n, at))
            at += n * size
    return [np.concatenate(o) if o else np.zeros(0, t) for o, t in zip(out, types, strict=True)]


def pairs(docs: DataFrame, buckets: int, hot) -> DataFrame:
    """(bucket, v, w, c, blob), staged: the training pairs with their counts, by bucket; those of frequent words packed,
    others a row each. Rows without a bucket count pairs: c of them were seen v times (beyond K + 1: by steps)."""
    schema = pa.schema([("bucket", pa.int64()), ("v", pa.binary()), ("w", pa.binary()), ("c", pa.binary())])

    def run(it):
        for held in _chunks(it, lambda d: not held_out(d)):
            w = np.concatenate([t for *_, t in held])
            v = _before(w, [len(t) for *_, t in held])
            key, at, c = _counted(_pairs(v, w))
            v, w = v[at], w[at]
            order, cut = by_bucket(hot.value.home(v, key, buckets), buckets)
            v, w, c = v[order], w[order], c[order].astype(np.int32)
            full = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *(pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()) for x in (v, w, c))], schema=schema)

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        v, w, c = (np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in (("v", np.uint64), ("w", np.uint64), ("c", np.int32)))
        key = _pairs(v, w)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        c = np.add.reduceat(c[order].astype(np.int64), first)
        v, w = v[order[first]], w[order[first]]
        cold = hot.value.find(w) < 0
        seen, times = np.unique(np.where(c <= K + 1, c, K + 2 + np.floor(np.log2(c) * 16).astype(np.int64)), return_counts=True)
        blobs = _packs(v[~cold], w[~cold], c[~cold].astype(np.int32))
        some, n, k = np.flatnonzero(cold), len(seen), len(blobs)
        m = len(some)
        return pa.table([
            pa.array([bucket] * (m + k) + [None] * n, pa.int64()),
            pa.concat_arrays([pa.array(v[some].view(np.int64)), pa.nulls(k, pa.int64()), pa.array(seen)]),
            pa.concat_arrays([pa.array(w[some].view(np.int64)), pa.nulls(n + k, pa.int64())]),
            pa.concat_arrays([pa.array(c[some]), pa.nulls(k, pa.int64()), pa.array(times)]),
            pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.binary())]),
        ], names=["bucket", "v", "w", "c", "blob"])

    packed = docs.mapInArrow(run, "bucket long, v binary, w binary, c binary")
    return stage_by(packed.groupBy("bucket").applyInArrow(count, "bucket long, v long, w long, c long, blob binary"), "bucket", buckets, "katz-pairs")


def discounts(counts: dict[int, int]) -> list[float]:
    """Katz's factors for counts 1 to K, from the numbers of types seen 1 to K + 1 times; where those give none that
    lies between 0 and 1, half a count is taken off."""
    n = [0.0] + [float(counts.get(r, 0)) for r in range(1, K + 2)]
    out = []
    for r in range(1, K + 1):
        d = math.nan
        if n[1] and n[r]:
            cut = (K + 1) * n[K + 1] / n[1]
            if cut != 1:
                d = ((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def _discounted(c: str, d: list[float]):
    factor = F.lit(1.0)
    for r, x in enumerate(d, 1):
        factor = F.when(F.col(c) == r, x).otherwise(factor)
    return F.col(c) * factor


def _reduced(c: np.ndarray, d: list[float]) -> np.ndarray:
    """Discounted counts."""
    factor = np.ones(len(c))
    for r, x in enumerate(d, 1):
        factor[c == r] = x
    return c * factor


def _backoff(q: np.ndarray, pw: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of contexts' weights, and of the share that their pairs keep, by sums over seen pairs."""
    share = np.where(q > 1 - 1e-9, c / (c + 1.0), 1.0)
    return np.log10((1 - share * q) / (1 - pw)), np.log10(share)


class Model:
    """N, V, the unknown type's log10 probability, and the staged table (bucket, kind, blob): packed pairs (kind 0), a key
    and what it adds to a score but for what frequent contexts add, whose places go along; and packed words (kind 1), a key,
    its count and its weight's log10. Every word is the context of as many pairs as it has occurrences, so the bucket of a
    context knows all of this."""

    def __init__(self, docs: DataFrame, buckets: int):
        sc = docs.sparkSession.sparkContext
        uni = words(docs)
        n, v = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.n, self.v, self.buckets = n, v, buckets
        d1 = discounts(dict(uni.filter(F.col("c") <= K + 1).groupBy("c").count().collect()))
        mass = uni.agg(F.coalesce(F.sum(_discounted("c", d1) / float(max(n, 1))), F.lit(0.0))).first()[0]
        self.unknown = math.log10(max(1.0 - mass, 1e-300))
        self.base0 = math.log10(0.5 / (n + 0.5 * (v + 1)))
        self.hot = sc.broadcast(Hot(uni))
        hot = self.hot
        seen_pairs = pairs(docs, buckets, hot)
        seen = {r.v: r.n for r in seen_pairs.filter("bucket is null").groupBy("v").agg(F.sum("c").alias("n")).collect()}  # some hundred rows
        d2 = discounts(seen)
        least, met = math.inf, 0  # the step from which on pairs are frequent
        for b in sorted((b for b in seen if b > K + 1), reverse=True):
            met += seen[b]
            if met > HOT:
                break
            least = b - K - 2

        def finish(packed: pa.Table, rows: pa.Table) -> pa.Table:
            bucket = (packed.column("bucket") if packed.num_rows else rows.column("home"))[0].as_py()
            h = hot.value
            pv, pw_, pc = _unpack(packed.column("blob").to_pylist(), np.uint64, np.uint64, np.int32)
            rv, rw, rc, rcw = (rows.column(x).to_numpy() for x in ("v", "w", "c", "cw"))
            v = np.concatenate([pv, rv.view(np.uint64)])
            w = np.concatenate([pw_, rw.view(np.uint64)])
            c = np.concatenate([pc.astype(np.int64), rc])
            cw = np.concatenate([h.c[h.find(pw_)] if len(pw_) else np.zeros(0, np.int64), rcw])
            key = _pairs(v, w)
            del pv, pw_, pc, rv, rw, rc, rcw, w
            order = np.argsort(v, kind="stable")
            v, key, c, cw = v[order], key[order], c[order], cw[order]
            del order
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))[: len(v)]
            size = np.diff(np.append(first, len(v)))
            at = h.find(v[first])
            many = np.where(at >= 0, h.c[at] if len(h.c) else 0, np.add.reduceat(c, first) if len(first) else 0)
            q = _reduced(c, d2) / np.repeat(many, size)
            own = _reduced(cw, d1) / n
            sq, sw = (np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (q, own))
            la, ls = np.zeros(len(first)), np.zeros(len(first))
            cold = np.flatnonzero(at < 0)
            la[cold], ls[cold] = _backoff(sq[cold], sw[cold], many[cold])
            x = np.log10(q) - np.log10(own) + np.repeat(ls - la, size)
            place = np.repeat(np.where(at >= 0, at, 0xFFFF), size).astype(np.uint16)
            warm = np.flatnonzero(at >= 0)
            top = np.flatnonzero(np.floor(np.log2(np.maximum(c, 1)) * 16) >= least)
            blobs = _packs(*_halves(key), x.astype(np.float32), place)
            own = _packs(*_halves(v[first[cold]]), many[cold].astype(np.int32), la[cold].astype(np.float32))
            k0, k1, k2, k3 = len(blobs), len(own), len(warm), len(top)
            return pa.table([
                pa.array([bucket] * (k0 + k1 + k2 + k3), pa.int64()),
                pa.array([0] * k0 + [1] * k1 + [2] * k2 + [3] * k3, pa.int32()),
                pa.concat_arrays([pa.nulls(k0 + k1, pa.int64()), pa.array(at[warm].astype(np.int64)), pa.array(key[top].view(np.int64))]),
                pa.concat_arrays([pa.nulls(k0 + k1, pa.float64()), pa.array(sq[warm]), pa.array(x[top])]),
                pa.concat_arrays([pa.nulls(k0 + k1, pa.float64()), pa.array(sw[warm]), pa.array(place[top].astype(np.float64))]),
                pa.concat_arrays([pa.array(blobs + own, pa.binary()), pa.nulls(k2 + k3, pa.binary())]),
            ], names=["bucket", "kind", "v", "x", "y", "blob"])

        rows = seen_pairs.filter("w is not null").select(F.col("bucket").alias("home"), "v", "w", "c").join(uni.select("w", F.col("c").alias("cw")), "w")
        packed = seen_pairs.filter("blob is not null").select("bucket", "blob")
        parts = packed.groupBy("bucket").cogroup(rows.groupBy("home")).applyInArrow(finish, "bucket long, kind int, v long, x double, y double, blob binary")
        parts = stage_by(parts, "bucket", buckets, "katz-model")  # read where its look-ups go, without a shuffle
        unstage(seen_pairs, uni)
        warm = {r.v: (r.q, r.w) for r in parts.filter("kind = 2").groupBy("v").agg(F.sum("x").alias("q"), F.sum("y").alias("w")).collect()}  # HOT rows at most
        h = hot.value
        sums = np.array([warm.get(k, (0.0, 0.0)) for k in range(len(h.w))], float).reshape(-1, 2)
        la, ls = _backoff(sums[:, 0], sums[:, 1], h.c)
        self.shift = np.append(ls - la, 0.0)  # what a frequent context adds to its pairs; the last: nothing
        base = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1))) - self.base0
        top = parts.filter("kind = 3").collect()  # HOT rows at most
        keys = np.concatenate([h.w, np.array([r.v for r in top], np.int64).view(np.uint64)])
        s = np.concatenate([np.log10(_reduced(h.c, d1) / max(n, 1)) + la - self.unknown, [r.x + self.shift[min(int(r.y), len(h.w))] for r in top]])
        b = np.concatenate([base(h.c), np.zeros(len(top))])
        known = np.concatenate([np.ones(len(h.w), np.int64), np.zeros(len(top), np.int64)])
        order = np.argsort(keys)
        self.known_to_all = keys[order], s[order], b[order], known[order]
        self.d1 = d1
        self.table = parts.filter("kind < 2").select("bucket", "kind", "blob")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(size // 6, PER_BUCKET, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    model = Model(docs, buckets)
    shared = docs.sparkSession.sparkContext.broadcast((model.known_to_all, model.unknown, model.base0, model.shift))
    n_train, n_types, d1 = max(model.n, 1), model.v, model.d1
    frequent = model.hot
    packed_type = pa.schema([("bucket", pa.int64()), ("base", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary()), ("place", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("n", pa.binary())])
    back_type = pa.schema([("part", pa.int64()), ("rows", pa.binary()), ("docs", pa.binary()), ("sums", pa.binary())])

    def run(it):
        from pyspark import TaskContext

        (hot, hs, hb, hk), unknown, base0, _ = shared.value
        task = TaskContext.get().partitionId()
        for held in _chunks(it, lambda d: True):
            sizes = [len(t) for *_, t in held]
            w = np.concatenate([t for *_, t in held])
            place = np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
            # a row is known by its task and its number there; a chunk's rows follow one another
            base = (task << 36) + held[0][0]
            names = np.array([(0 if d is None else d, d is None) for _, d, _ in held], np.int64)
            sums = np.zeros((len(held), 4))  # tokens, known, base, score
            sums[:, 0] = sizes
            sums[:, 2] = sums[:, 0] * base0
            sums[:, 3] = sums[:, 0] * unknown
            v = _before(w, sizes)
            key = _pairs(v, w)
            home = np.concatenate([mix(w).view(np.int64) % buckets, frequent.value.home(v, key, buckets)]).astype(np.int32)
            key = np.concatenate([w, key])
            place = np.concatenate([place, place])
            if len(hot):
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                hit = hot[at] == key
                at, own = at[hit], place[hit]
                for col, x in ((1, hk), (2, hb), (3, hs)):
                    sums[:, col] += np.bincount(own, x[at], len(held))
                key, place, home = key[~hit], place[~hit], home[~hit]
            own, at, n, order = _counted(key, True)
            # keys and places as one number, sorted: a key's number among the distinct ones, and the place below it
            both = (np.repeat(np.arange(len(own), dtype=np.uint64), n) << np.uint64(16)) | place[order]
            both.sort()
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))[: len(both)]
            n = np.diff(np.append(first, len(both)))
            both = both[first]
            code, place = (both >> np.uint64(16)).view(np.int64), both.astype(np.uint16)
            key, home = own[code], home[at][code]
            order = np.argsort(place, kind="stable")  # entries go by bucket, then by row
            again, cut = by_bucket(home[order], buckets)
            order = order[again]
            key, place, n = key[order], place[order], n[order]
            rows = [(p, None, d, s, r, None, None, None) for p, r, d, s in _parts(base + np.arange(len(held)), names, sums, buckets)]
            for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                own = slice(cut[b], cut[b + 1])
                at = np.flatnonzero(np.concatenate(([True], place[own][1:] != place[own][:-1])))
                sizes = np.diff(np.append(at, cut[b + 1] - cut[b]))
                short = 2 * len(at) < len(place[own]) and sizes.max() < 1 << 16
                where = (place[own][at].tobytes(), sizes.astype(np.uint16).tobytes()) if short else (place[own].tobytes(), None)
                hi, lo = _halves(key[own])
                many = np.flatnonzero(n[own] > 1).astype(np.uint32)
                rows.append((b, base, None, None, *where, hi.tobytes() + lo.tobytes(), many.tobytes() + n[own][many].astype(np.uint32).tobytes()))
            for k in range(0, len(rows), 500):
                part = rows[k : k + 500]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], packed_type.types[c]) for c in range(8)], schema=packed_type)

    def look_up(entries: pa.Table, model: pa.Table) -> pa.Table:
        _, unknown, base0, shift = shared.value
        blobs = [[], []]
        for k, x in zip(model.column("kind").to_pylist(), model.column("blob").to_pylist(), strict=True):
            blobs[k].append(x)
        hi, lo, ps, pp = _unpack(blobs[0], np.uint16, np.uint32, np.float32, np.uint16)
        pk = (hi.astype(np.uint64) << np.uint64(32)) | lo
        ps = ps + shift[np.minimum(pp, len(shift) - 1)]
        hi, lo, c, la = _unpack(blobs[1], np.uint16, np.uint32, np.int32, np.float32)
        wk = (hi.astype(np.uint64) << np.uint64(32)) | lo
        ws, wb = np.log10(_reduced(c, d1) / n_train) + la - unknown, np.log10((c + 0.5) / (n_train + 0.5 * (n_types + 1))) - base0
        key = np.concatenate([wk, pk])
        s, b, known = np.concatenate([ws, ps]), np.concatenate([wb, np.zeros(len(pk))]), np.concatenate([np.ones(len(wk)), np.zeros(len(pk))])
        del hi, lo, pk, ps, pp
        order = np.argsort(key)
        key, s, b, known = key[order], s[order], b[order], known[order]
        out, ready = [], []
        for bucket, base, d, sums, place, sizes, keys, n in zip(*(entries.column(c).to_pylist() for c in packed_type.names), strict=True):
            if sums is not None:
                ready.append((bucket, place, d, sums))
            elif len(key):
                place = np.frombuffer(place, np.uint16)
                if sizes is not None:
                    place = np.repeat(place, np.frombuffer(sizes, np.uint16))
                m = len(place)
                k = (np.frombuffer(keys, np.uint16, m).astype(np.uint64) << np.uint64(32)) | np.frombuffer(keys, np.uint32, m, 2 * m)
                many = np.frombuffer(n, np.uint32).reshape(2, -1)
                times = np.ones(m)
                times[many[0]] = many[1]
                at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                hit = np.flatnonzero(key[at] == k)
                if len(hit):
                    at, place, times = at[hit], place[hit], times[hit]
                    size = int(place.max()) + 1
                    got = np.zeros((size, 4))
                    for col, x in ((1, known), (2, b), (3, s)):
                        got[:, col] = np.bincount(place, times * x[at], size)
                    some = np.unique(place)
                    out.append((base + some.astype(np.int64), got[some]))
        if out:
            ready += _parts(np.concatenate([i for i, _ in out]), None, np.concatenate([x for _, x in out]), buckets)
        return pa.table([pa.array([r[c] for r in ready], back_type.types[c]) for c in range(4)], schema=back_type)

    def gather(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), np.int64)
        sums = np.frombuffer(b"".join(table.column("sums").to_pylist()), np.float64).reshape(-1, 4)
        named = [(r, d) for r, d in zip(table.column("rows").to_pylist(), table.column("docs").to_pylist(), strict=True) if d is not None]
        own = np.frombuffer(b"".join(r for r, _ in named), np.int64)  # each row once
        names = np.frombuffer(b"".join(d for _, d in named), np.int64).reshape(-1, 2)
        order = np.argsort(own)
        own, names = own[order], names[order]
        at = np.searchsorted(own, rows)
        total = [np.bincount(at, sums[:, c], len(own)) for c in range(4)]
        doc = pa.array(names[:, 0], mask=names[:, 1].astype(bool))
        out = [held_out(d) for d in doc.to_pylist()]
        return pa.table([doc, pa.array(out), pa.array(np.rint(total[0]).astype(np.int64)), pa.array(np.rint(total[1]).astype(np.int64)), pa.array(total[2]), pa.array(total[3])], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    packed = docs.mapInArrow(run, "bucket long, base long, docs binary, sums binary, place binary, sizes binary, keys binary, n binary")
    tables = model.table
    back = packed.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(look_up, "part long, rows binary, docs binary, sums binary")
    back = stage(back, "katz-sums")
    out = back.groupBy("part").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def _parts(rows: np.ndarray, names: np.ndarray | None, sums: np.ndarray, parts: int):
    """(part, rows, their names, sums), a row's sums added up first; rows with names are there once."""
    if names is None:
        rows, own = np.unique(rows, return_inverse=True)
        sums = np.stack([np.bincount(own, sums[:, c], len(rows)) for c in range(4)], axis=1)
    order, cut = by_bucket(mix(rows.view(np.uint64)).view(np.int64) % parts, parts)
    rows, sums = rows[order], sums[order]
    names = None if names is None else names[order]
    for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        own = slice(cut[p], cut[p + 1])
        yield p, rows[own].tobytes(), None if names is None else names[own].tobytes(), sums[own].tobytes()
