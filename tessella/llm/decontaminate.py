"""Benchmark decontamination: a generalised suffix automaton of the normalised items, and documents streamed through it.

The automaton holds every word sequence of the items. A document's words walk it; after each word the state and the
matched length are those of the longest item sequence that ends there. A match of at least `window` words (or a
whole item of fewer) marks its last `window` words as hit.

Defined results: null, empty and wordless texts give no words and no hits; null or wordless items never occur; an
item given twice counts as two items if the ids differ; ties do not arise, since all occurrences count; repeated rows
and rows with a null doc_id are judged each by itself; an empty table of documents gives no rows, an empty one of items
no hits. Extra columns go along whatever their names, or are not read. A text is walked whole, in memory linear in
the longest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import ALNUM, stage, texts, unstage

#: The normalised words, in the text as it stands.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """Over the word sequences of (item id, words). States and edges are linear in the words of the items; a state of
    `window` words or more also lists the items that hold its words, so a passage of many items counts once for each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.names = [name for name, _ in items]
        ends: list[list[int]] = []
        for _, words in items:
            last, path = 0, []
            for w in words:
                last = self._add(last, self.vocab.setdefault(w, len(self.vocab)))
                path.append(last)
            ends.append(path)
        # a prefix state may have been cloned later; walk again for the states that hold now
        self.items: dict[int, set[int]] = {}
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        own: dict[int, list[tuple[int, int]]] = {}
        sizes = []
        for k, (_, words) in enumerate(items):
            s = 0
            for w in words:
                s = self.next[s][self.vocab[w]]
                t = s
                while self.len[t] >= window and k not in self.items.setdefault(t, set()):
                    self.items[t].add(k)
                    t = self.link[t]
            if words:
                sizes.append(min(len(words), window))
            if 0 < len(words) < window:
                own.setdefault(s, []).append((len(words), k))
        self.shortest = min(sizes, default=0)
        for s in sorted(range(1, len(self.next)), key=self.len.__getitem__):  # suffix links lead to shorter states
            self.whole[s] = self.whole[self.link[s]] + tuple(own.get(s, ()))

    def _add(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items with occurring windows. Only runs of known words enter the automaton."""
        hit, found = np.zeros(len(words), bool), set()
        if not self.shortest or len(words) < self.shortest:
            return hit, found
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([False], ids >= 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        runs = edge.reshape(-1, 2)
        spans: list[tuple[int, int]] = []
        nxt, link, length, n = self.next, self.link, self.len, self.window
        for b, e in runs[runs[:, 1] - runs[:, 0] >= self.shortest].tolist():
            s = matched = 0
            for i, c in enumerate(ids[b:e].tolist(), b):
                while s and c not in nxt[s]:
                    s = link[s]
                    matched = length[s]
                if c in nxt[s]:
                    s = nxt[s][c]
                    matched += 1
                if matched >= n:
                    t = s
                    while length[link[t]] >= n:
                        t = link[t]
                    found |= self.items_of_window(t)
                    spans.append((i + 1 - n, i + 1))
                for m, k in self.whole[s]:
                    if m <= matched:
                        found.add(k)
                        spans.append((i + 1 - m, i + 1))
        for b, e in spans:
            hit[b:e] = True
        return hit, found

    def items_of_window(self, state: int) -> set[int]:
        return self.items[state]


def item_blocks(items: DataFrame, item_id: str, text: str, most_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most most_words words (one longer item is a block of its own), read one partition
    at a time, so that what is built and broadcast at once has a fixed bound."""
    block, size = [], 0
    for r in items.select(F.col(item_id).cast("string").alias("k"), F.col(text).alias("t")).toLocalIterator():
        words = (r.t or "").encode().translate(ALNUM).split()
        if words and r.k is not None:
            if block and size + len(words) > most_words:
                yield block
                block, size = [], 0
            block.append((r.k, words))
            size += len(words)
    yield block


def _passes(docs: DataFrame, blocks: Iterator, window: int, text: str, give, schema) -> DataFrame:
    """One pass over the documents for each block. A pass hands on whole rows with what is hit so far, staged, so rows
    need no key and no two blocks are held at once; the last one gives give(batch, hits, items) of what all have hit:
    bool arrays over the words of the text as it came, and sorted item ids."""
    spark, block, first = docs.sparkSession, next(blocks), True
    handed = StructType([StructField("doc", docs.schema), StructField("hits", ArrayType(ArrayType(LongType()))), StructField("items", ArrayType(StringType()))])
    while True:
        more = next(blocks, None)
        shared = spark.sparkContext.broadcast(SuffixAutomaton(block, window))

        def walk(it, shared=shared, first=first, last=more is None):
            auto = shared.value
            for batch in it:
                doc = batch if first else pa.RecordBatch.from_struct_array(batch.column("doc"))
                hits, names = [], []
                for t in texts(doc, text):
                    hit, found = auto.scan(t.translate(ALNUM).split())
                    hits.append(hit)
                    names.append({auto.names[k] for k in found})
                if not first:
                    for hit, spans in zip(hits, batch.column("hits").to_pylist(), strict=True):
                        for b, e in spans:
                            hit[b:e] = True
                    names = [n.union(o) for n, o in zip(names, batch.column("items").to_pylist(), strict=True)]
                names = list(map(sorted, names))
                if last:
                    yield give(doc, hits, names)
                else:
                    yield pa.RecordBatch.from_arrays([doc.to_struct_array(), pa.array(list(map(_spans, hits)), pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string()))], names=["doc", "hits", "items"])

        out = docs.mapInArrow(walk, schema if more is None else handed)
        if more is None:
            return out
        out = stage(out, "hits")
        shared.destroy()
        if not first:
            unstage(docs)
        docs, block, first = out, more, False


def scan(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", most_words: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, hits (array of [start, end) word spans, merged and in order), items (array of item ids as
    strings, sorted) of every row. An item set over most_words words is scanned for in blocks, one pass over the
    documents each."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def give(batch, hits, names):
        n = pa.array(list(map(len, hits)), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), n, pa.array(list(map(_spans, hits)), schema.field("hits").type), pa.array(names, pa.list_(pa.string()))], schema=schema)

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _passes(docs, item_blocks(items, item_id, item_text, most_words), window, "text", give, "doc_id long, n_words long, hits array<array<long>>, items array<string>")


def _spans(hit: np.ndarray) -> list[list[int]]:
    x = np.concatenate(([False], hit, [False]))
    return np.flatnonzero(x[1:] != x[:-1]).reshape(-1, 2).tolist()


def digest(found: DataFrame) -> DataFrame:
    """The per-document figures of scan()."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(docs: DataFrame, items: DataFrame, window: int = 10, longest: int = 10, coverage: float = 0.8,
           text: str = "text", item_id: str = "item_id", item_text: str = "text", most_words: int = 2_000_000) -> DataFrame:
    """The documents without what they share with the items: a hit span of `longest` or more words is cut out of the
    text; a document of whose words a share over `coverage` is hit goes as a whole. Other columns stay as they are,
    but for n_chars, which is counted again if it is there. Spans of fewer words (short whole items) stay unless they exceed the coverage. Items beyond
    most_words words are taken block by block; what all of them hit in the text as it came decides once."""
    schema = docs.schema

    def give(batch, hits, names):
        at = batch.schema.get_field_index(text)
        new, keep = [], []
        for t, hit, found in zip(batch.column(at).cast(pa.binary()).to_pylist(), hits, names, strict=True):
            keep.append(not found or hit.sum() <= coverage * len(hit))
            new.append(_without(t, hit, longest) if found and keep[-1] else t)
        columns = list(batch.columns)
        columns[at] = pa.array(new, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    docs = _passes(docs, item_blocks(items, item_id, item_text, most_words), window, text, give, schema)
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text).cast(schema["n_chars"].dataType)))
    return docs


def _without(t: bytes, hit: np.ndarray, longest: int) -> bytes:
    at = [m.span() for m in WORD.finditer(t)]
    out, pos = [], 0
    for b, e in _spans(hit):
        if e - b >= longest:
            out.append(t[pos : at[b][0]])
            pos = at[e - 1][1]
    return b"".join([*out, t[pos:]])

