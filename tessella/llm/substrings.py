"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted in Spark by hash.

Each task hashes all windows of its documents, and packs them for every `FLUSH` windows: of equal hashes only the one
with the smallest doc_id is sent on, together with its document, to the bucket that a second, independent hash names;
the others are known as repeats at once. So a window that a third of all documents hold is sent once for each flush,
never once for each document, and a bucket's size depends on the number of buckets alone. A bucket sorts its hashes
and finds, for each, the smallest doc_id and the documents above it. Repeats go back packed by groups of documents,
and in a document overlapping windows merge into maximal intervals.

A window counts as a repeat only if the same words start in a document with a smaller doc_id; repeats inside one
document don't count. Windows are told apart by 64 bits and the bits of their bucket. Defined results: null, empty and
wordless texts and texts shorter than the window lose nothing; repeated rows with one doc_id count as one document;
rows with a null doc_id are neither source nor target; an empty table gives no rows; other columns go along whatever
their names; a text is hashed whole, in memory linear in the longest. Windows are judged on the input, whatever is removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, Powers, bucket_count, by_bucket, covered, stage, texts

#: Windows that a task gathers before it packs them, and windows for each bucket.
FLUSH, PER_BUCKET, MOST_DOCS = 1_500_000, 2_000_000, 60_000
KEY_BASE, BUCKET_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
PACKED = pa.schema([("bucket", pa.int64()), ("back", pa.bool_()), ("docs", pa.binary()), ("place", pa.binary()), ("keys", pa.binary())])
BACK = pa.schema([("part", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary())])


def n_buckets(docs: DataFrame, text: str = "text") -> int:
    """By the bytes of all texts, at about six to a word."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("s")).first().s or 0
    return bucket_count(size // 6, PER_BUCKET, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _packer(window: int, buckets: int) -> Callable:
    def run(it):
        hashes, keys, second = Hashes(), Powers(KEY_BASE), Powers(BUCKET_BASE)
        held, size = [], 0
        for batch in it:
            for d, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                words = t.split()
                if d is None or len(words) < window:
                    continue
                h = hashes.of(words)
                held.append((d, keys.windows(h, window), second.windows(h, window) % np.uint64(buckets)))
                size += len(words)
                if size >= FLUSH or len(held) >= MOST_DOCS:
                    yield from _pack(held, buckets)
                    held, size = [], 0
        if held:
            yield from _pack(held, buckets)

    return run


def _pack(held: list, buckets: int):
    held.sort(key=lambda x: x[0])
    ids = np.array([d for d, _, _ in held], np.int64)
    place = np.repeat(np.arange(len(held), dtype=np.uint16), [len(k) for _, k, _ in held])
    key = np.concatenate([k for _, k, _ in held])
    bucket = np.concatenate([b for _, _, b in held]).astype(np.int64)
    order = np.argsort(key, kind="stable")  # smaller doc_ids first among equal keys
    key, place, bucket = key[order], place[order], bucket[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    lead = ids[place[np.flatnonzero(first)]][np.cumsum(first) - 1]
    later = np.flatnonzero(~first & (ids[place] != lead))
    rows = [(p, True, d, n, k) for p, d, n, k in _back(ids[place[later]], key[later], buckets)]
    at = np.flatnonzero(first)
    order, bounds = by_bucket(bucket[at], buckets)
    at = at[order]
    used = np.zeros(len(ids), bool)
    for b in range(buckets):
        own = at[bounds[b] : bounds[b + 1]]
        if len(own):
            used[:] = False
            used[place[own]] = True
            local = (np.cumsum(used) - 1).astype(np.uint16)
            rows.append((b, False, ids[used].tobytes(), local[place[own]].tobytes(), key[own].tobytes()))
    for k in range(0, len(rows), 2000):
        part = rows[k : k + 2000]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], PACKED.types[c]) for c in range(5)], schema=PACKED)


def _back(doc: np.ndarray, key: np.ndarray, parts: int):
    """(part, its documents, how many distinct keys each has, those keys): parts of documents by doc_id."""
    if not len(doc):
        return
    part = doc % parts
    order = np.lexsort((key, doc, part))
    doc, key, part = doc[order], key[order], part[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
    doc, key, part = doc[new], key[new], part[new]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    for b, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        starts = np.flatnonzero(np.concatenate(([True], doc[b + 1 : e] != doc[b : e - 1])))
        sizes = np.diff(np.append(starts, e - b)).astype(np.int32)
        yield int(part[b]), doc[b:e][starts].tobytes(), sizes.tobytes(), key[b:e].tobytes()


def _repeats(parts: int) -> Callable:
    """Of one bucket: the keys that a smaller doc_id has too, packed by parts of the documents."""

    def run(table: pa.Table) -> pa.Table:
        keys, docs, ready = [], [], []
        for bucket, back, d, p, k in zip(*(table.column(c).to_pylist() for c in PACKED.names), strict=True):
            if back:
                ready.append((bucket, d, p, k))
            else:
                keys.append(np.frombuffer(k, np.uint64))
                docs.append(np.frombuffer(d, np.int64)[np.frombuffer(p, np.uint16)])
        if keys:
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            lead = np.minimum.reduceat(doc, np.flatnonzero(first))[np.cumsum(first) - 1]
            later = doc != lead
            ready += _back(doc[later], key[later], parts)
        return pa.table([pa.array([r[c] for r in ready], BACK.types[c]) for c in range(4)], schema=BACK)

    return run


def _gather(table: pa.Table) -> pa.Table:
    """Of one part: each document's keys."""
    own: dict[int, list[bytes]] = {}
    for d, n, k in zip(*(table.column(c).to_pylist() for c in ("docs", "sizes", "keys")), strict=True):
        at = 0
        for doc, size in zip(np.frombuffer(d, np.int64).tolist(), np.frombuffer(n, np.int32).tolist(), strict=True):
            own.setdefault(doc, []).append(k[at : at + 8 * size])
            at += 8 * size
    return pa.table([pa.array(list(own), pa.int64()), pa.array([b"".join(x) for x in own.values()], pa.binary())], names=["doc_id", "repeat_keys"])


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, repeat_keys): the hashes of each document's windows that start in a smaller doc_id too. Only
    documents that have such windows. Both passes are staged, so that their shuffle files can go."""
    docs = docs.select("doc_id", "text")
    buckets = n_buckets(docs)
    packed = docs.mapInArrow(_packer(window, buckets), "bucket long, back boolean, docs binary, place binary, keys binary")
    back = stage(packed.groupBy("bucket").applyInArrow(_repeats(buckets), "part long, docs binary, sizes binary, keys binary"), "substring-parts")
    return stage(back.groupBy("part").applyInArrow(_gather, "doc_id long, repeat_keys binary"), "substring-repeats")


class Marker:
    """Which words of a text lie in its repeated windows."""

    def __init__(self, window: int):
        self.window, self.hashes, self.powers = window, Hashes(), Powers(KEY_BASE)

    def hit(self, words: list[bytes], keys: bytes) -> np.ndarray:
        own = self.powers.windows(self.hashes.of(words), self.window)
        there = np.isin(own, np.frombuffer(keys, np.uint64))
        return covered(np.flatnonzero(there), self.window, len(words))


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    return docs.join(found.hint("shuffle_hash"), "doc_id", "left")


def digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""

    def run(it):
        mark = Marker(window)
        for batch in it:
            n, gone, sha = [], [], []
            for t, keys in zip(texts(batch), batch.column("repeat_keys").to_pylist(), strict=True):
                words = t.split()
                n.append(len(words))
                if keys:
                    hit = mark.hit(words, keys)
                    words = [words[i] for i in np.flatnonzero(~hit).tolist()]
                gone.append(n[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), repeats(docs, window))
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, window: int = 50, text: str = "text") -> DataFrame:
    """The documents without the maximal intervals of repeated windows; between kept words the text stays as it is.
    n_chars, if it is there, is counted again. A document that loses all words stays, with what white space is left."""
    schema, at = docs.schema, docs.columns.index(text)

    def run(it):
        mark = Marker(window)
        for batch in it:
            doc = pa.RecordBatch.from_struct_array(batch.column("doc"))
            new = []
            for t, keys in zip(doc.column(at).cast(pa.binary()).to_pylist(), batch.column("repeat_keys").to_pylist(), strict=True):
                new.append(_cut(t, mark.hit(t.split(), keys)) if keys and t else t)
            columns = list(doc.columns)
            columns[at] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=doc.schema)

    found = repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), window)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    out = _joined(packed, found).select("doc", "repeat_keys").mapInArrow(run, schema)  # one struct: no name can clash
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text).cast(schema["n_chars"].dataType)))
    return out


def _cut(t: bytes, hit: np.ndarray) -> bytes:
    at = [m.span() for m in WORD.finditer(t)]
    x = np.concatenate(([False], hit, [False]))
    out, pos = [], 0
    for b, e in np.flatnonzero(x[1:] != x[:-1]).reshape(-1, 2).tolist():
        out.append(t[pos : at[b][0]])
        pos = at[e - 1][1]
    return b"".join([*out, t[pos:]])
