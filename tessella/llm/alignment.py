"""Cross-tokenizer alignment: the tokens that a byte-level BPE (A) and a SentencePiece model (B) make of the same text,
cut into the smallest groups that end at one byte, by a dangling-suffix transducer.

A state of the transducer is which side leads and its bytes that the other side has not matched yet; the next token of
the side behind moves it on. States remember their transitions by token, and an empty residual closes a group. Texts
are walked from one space between two visible characters to the next: both models begin a token there, so the residual
is empty, and a task remembers whole walks from the empty state to the empty state by the bytes between (up to `KEPT`
of them, none longer than `SHORT` characters; then it forgets the ones used least, which changes no result).

The A-B links of a text are the last tokens of its groups, as no token of either model is without bytes. A task packs
the links of about `PART` at a time as places in the part's list of distinct id pairs, so that counts meet once for
each pair and part instead of each occurrence: a pair that all documents hold is a row for each part. Pairs are counted
and compared with their B id's best by joins, and come back to the packed parts.

Defined results: null and empty texts, and texts whose tokens of either side spell something else than a space and the
text, have no tokens: zeros and an empty digest; a doc_id may be null or repeated, each row has its own result; equal
texts have equal results; a text of any length is walked whole, one at a time; an empty table gives no rows; columns
but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: How byte-level tokenizers split words (a fixed public pattern).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S) (?=\S)")
KEPT, SHORT, PART, TEXTS, LEARNT = 200_000, 64, 1_000_000, 250, 5_000
#: An id pair as one number: A's id times SIDES plus B's.
SIDES = 1 << 24
ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
PACKED = "part long, docs binary, sizes binary, digests binary, places binary, pairs array<long>, counts array<long>"


class State(dict):
    """Token to the next state, for the token of the side behind; made when first asked for. `ahead` is 1 where A
    leads, and -1 where B does."""

    def __init__(self, walks: Transducer, ahead: int, residual: bytes):
        self.walks, self.ahead, self.residual = walks, ahead, residual

    def __missing__(self, token: int) -> State | None:
        new = (self.walks.b if self.ahead > 0 else self.walks.a)[token]
        old = self.residual
        if old.startswith(new):
            to = self.walks.state(self.ahead, old[len(new) :])
        else:
            to = self.walks.state(-self.ahead, new[len(old) :]) if new.startswith(old) else None
        self[token] = to
        return to


class Transducer:
    def __init__(self, a: list[bytes], b: list[bytes], most: int = 500_000):
        self.a, self.b, self.most = a, b, most
        self.forget()

    def forget(self) -> None:
        self.first: dict[int, State] = {}
        self.states: dict[tuple[int, bytes], State] = {}

    def state(self, ahead: int, residual: bytes) -> State | None:
        if not residual:
            return DONE
        found = self.states.get((ahead, residual))
        if found is None:
            found = self.states[ahead, residual] = State(self, ahead, residual)
        return found

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many tokens of A and of B have ended with each group; None if they spell different bytes."""
        if len(self.states) + len(self.first) > self.most:
            self.forget()
        a_ends, b_ends = [], []
        i = j = 0
        try:
            while i < len(a):
                s = self.first.get(a[i])
                if s is None:
                    s = self.first[a[i]] = self.state(1, self.a[a[i]])
                i += 1
                while s is not DONE:
                    if s.ahead > 0:
                        s = s[b[j]]
                        j += 1
                    else:
                        s = s[a[i]]
                        i += 1
                    if s is None:
                        return None
                a_ends.append(i)
                b_ends.append(j)
        except IndexError:
            return None
        return (a_ends, b_ends) if j == len(b) else None


DONE = State(None, 0, b"")


def byte_entries(tokenizer) -> list[bytes]:
    """The bytes of a byte-level tokenizer's entries: their characters stand for bytes, the visible ones of Latin-1 for
    themselves and the others, in order, for the characters from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [k for k in range(256) if k not in set(seen)]
    back = {chr(c): bytes([c]) for c in seen} | {chr(256 + k): bytes([c]) for k, c in enumerate(rest)}
    out = [b""] * tokenizer.get_vocab_size()
    for entry, k in tokenizer.get_vocab().items():
        out[k] = b"".join(back.get(c, c.encode()) for c in entry)
    return out


def by_ranks(file: str, entries: list[bytes]):
    """The byte-level tokenizer as ranks of merges, several times faster; None where its ids are no such ranks (bytes
    first, then one entry for each merge in order) or it has another way to split words."""
    import tiktoken

    with open(file, encoding="utf-8") as f:
        made = json.load(f)
    model, split = made["model"], made.get("pre_tokenizer") or {}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = made.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain or any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(pairs)) or {*map(len, entries[:256])} != {1}:
        return None
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks={entries[k]: k for k in range(256 + len(pairs))}, special_tokens={})


def piece_entries(model) -> list[bytes]:
    """The bytes of a SentencePiece model's pieces: U+2581 is a space, a byte piece its byte."""
    names = map(model.id_to_piece, range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]


class Column:
    """An array that grows."""

    def __init__(self, kind: type, *more: int):
        self.held, self.n = np.zeros((1024, *more), kind), 0

    def add(self, rows: np.ndarray) -> None:
        while self.n + len(rows) > len(self.held):
            self.held = np.concatenate((self.held, np.zeros_like(self.held)))
        self.held[self.n : self.n + len(rows)] = rows
        self.n += len(rows)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of every run of a size from a start on, run after run."""
    end = np.cumsum(sizes)
    return np.repeat(starts - end + sizes, sizes) + np.arange(end[-1] if len(end) else 0)


class Aligner:
    """Both models and what a task remembers of its texts' parts."""

    def __init__(self, a_file: str, b_file: str, kept: int = KEPT):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a_bytes, self.b_bytes = byte_entries(self.a), piece_entries(self.b)
        self.a_sizes = np.array([*map(len, self.a_bytes)], np.int64)
        self.ranks = by_ranks(a_file, self.a_bytes)
        # a piece with a space behind another character would cross from one walk into the next
        self.whole = any(b" " in p.lstrip(b" ") for p in self.b_bytes)
        self.walks = Transducer(self.a_bytes, self.b_bytes)
        # ids as they are written inside a group, at the end of A's or B's side, and at the end of a walk
        self.written = [f"{k}{mark}" for n, mark in ((len(self.a_bytes), ","), (len(self.a_bytes), "|"), (len(self.b_bytes), ","), (len(self.b_bytes), ";"), (len(self.b_bytes), "\n")) for k in range(n)]
        self.kept = kept
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.names: list[str | None] = []
        self.text: list[str] = []
        self.uses = np.zeros(0, np.int64)
        #: for each walk: A tokens, B tokens, groups (-1 if the sides don't match), and where these begin in the columns
        self.walked = Column(np.int64, 6)
        self.a_ids, self.b_ids = Column(np.int32), Column(np.int32)
        #: for each group: its end among the walk's A and B tokens, and its link
        self.a_ends, self.b_ends, self.links = Column(np.int32), Column(np.int32), Column(np.int64)

    def forget_rare(self) -> None:
        """Keep the half of what may be kept that was used most, if more than once."""
        named = np.array([n is not None for n in self.names])
        keep = np.flatnonzero(named & (self.uses >= 2))
        keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: self.kept // 2]])
        w, old = self.walked.held[keep], (self.a_ids, self.b_ids, self.a_ends, self.b_ends, self.links)
        names, text = [self.names[k] for k in keep], [self.text[k] for k in keep]
        self.forget()
        n = np.maximum(w[:, 2], 0)
        at = runs(w[:, 3], n), runs(w[:, 4], w[:, 0]), runs(w[:, 5], w[:, 1])
        for new, held, place in zip((self.a_ids, self.b_ids, self.a_ends, self.b_ends, self.links), old, (at[1], at[2], at[0], at[0], at[0]), strict=True):
            new.add(held.held[place])
        self.walked.add(np.column_stack((w[:, :3], *[np.cumsum(x) - x for x in (n, w[:, 0], w[:, 1])])))
        self.names, self.text, self.known, self.uses = names, text, {n: k for k, n in enumerate(names)}, np.zeros(len(names), np.int64)

    @property
    def sizes(self) -> np.ndarray:
        return self.walked.held

    def split(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        parts = text.split(" ")
        return parts if "" not in parts and list(map(str.strip, parts)) == parts else CUT.split(text)

    def learn(self, new: list[str]) -> None:
        """Tokens and groups of parts of texts, each with the space before it."""
        for k in range(0, len(new), LEARNT):
            some = new[k : k + LEARNT]
            self._learn(some, self.encode_a(some), self.b.encode(some, num_threads=1))

    def encode_a(self, new: list[str]) -> list[list[int]]:
        """The A tokens of each, with the space before it: short ones as one text, by the same vocabulary's ranks."""
        if self.ranks is not None and max(map(len, new)) <= SHORT:
            ids = self.ranks.encode_ordinary(" " + " ".join(new))
            at = np.cumsum(self.a_sizes[np.array(ids)])
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, new)), np.int64, len(new)) + 1)
            cut = np.searchsorted(at, ends) + 1
            if at[-1] == ends[-1] and np.array_equal(at[cut - 1], ends):
                cut = cut.tolist()
                return [ids[i:j] for i, j in zip([0, *cut], cut, strict=False)]
        return [e.ids for e in self.a.encode_batch_fast([" " + p for p in new], add_special_tokens=False)]

    def _learn(self, new: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        """One walk over all of them; where that fails, over halves, down to the ones that don't match."""
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        right = b"".join(map(self.a_bytes.__getitem__, flat_a)) == b"".join([b" " + p.encode() for p in new])
        ends = self.walks.groups(flat_a, flat_b) if right else None
        if ends is None and len(new) > 1:
            half = len(new) // 2
            self._learn(new[:half], a[:half], b[:half])
            self._learn(new[half:], a[half:], b[half:])
            return
        starts = np.array([self.links.n, self.a_ids.n, self.b_ids.n])
        if ends is None:
            self.walked.add(np.array([[0, 0, -1, *starts]]))
            self.text.append("")
            return
        x, y = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        end_a, end_b = (np.array(e, np.int64) for e in ends)
        of_a, of_b = (np.array([*map(len, n)], np.int64) for n in (a, b))
        before_a, before_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        n = np.diff(np.searchsorted(end_a, np.append(before_a, len(x)), "right"))
        self.walked.add(np.column_stack((of_a, of_b, n, starts[0] + np.cumsum(n) - n, starts[1] + before_a, starts[2] + before_b)))
        self.a_ids.add(x)
        self.b_ids.add(y)
        self.a_ends.add(end_a - np.repeat(before_a, n))
        self.b_ends.add(end_b - np.repeat(before_b, n))
        self.links.add(x[end_a - 1] * SIDES + y[end_b - 1])
        # in writing, a group's A tokens stand behind all tokens of the groups before, its B tokens behind its A tokens
        in_a, in_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        place_a = np.arange(len(x)) + np.repeat(end_b - in_b, in_a)
        place_b = np.arange(len(y)) + np.repeat(end_a, in_b)
        mark_a, mark_b = np.zeros(len(x), np.int64), np.full(len(y), 2 * len(self.a_bytes))
        mark_a[end_a - 1] = len(self.a_bytes)
        mark_b[end_b - 1] += len(self.b_bytes)
        mark_b[before_b + of_b - 1] += len(self.b_bytes)
        written = np.empty(len(x) + len(y), np.int64)
        written[place_a], written[place_b] = x + mark_a, y + mark_b
        self.text += "".join(map(self.written.__getitem__, written.tolist())).split("\n")[:-1]

    def walk(self, texts: list[str | None]) -> list[list[int]]:
        """The places of each text's parts among what is remembered."""
        if len(self.text) > self.kept:
            self.forget_rare()
        known, out, new = self.known, [], []
        at = len(self.text)
        for t in texts:
            places = []
            if t:
                for p in self.split(t):
                    k = known.get(p)
                    if k is None:
                        k = at + len(new)
                        new.append(p)
                        if len(p) <= SHORT:
                            known[p] = k
                    places.append(k)
            out.append(places)
        if new:
            self.learn(new)
            self.names += [p if len(p) <= SHORT else None for p in new]
        used = np.bincount(np.fromiter(chain.from_iterable(out), np.int64), minlength=len(self.text))
        used[: len(self.uses)] += self.uses
        self.uses = used
        return out


@lru_cache(1)
def aligner(a_file: str, b_file: str) -> Aligner:
    """A worker's own, which outlives its tasks: models are read once, and what is known stays known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Aligner(a_file, b_file)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str | None]]]:
    """doc_ids and texts, some at a time, so that what is remembered stays near its bound."""
    for k in range(0, batch.num_rows, TEXTS):
        some = batch.slice(k, TEXTS)
        yield some.column("doc_id").to_pylist(), some.column("text").to_pylist()


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Every document's token ids under both models, and how many tokens of each have ended with each group."""

    def run(rows):
        own = aligner(a_file, b_file)
        schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.list_(pa.int32())) for n in ("a_ids", "b_ids", "a_ends", "b_ends")]])
        for batch in rows:
            for ids, texts in _texts(batch):
                out = []
                for d, places in zip(ids, own.walk(texts), strict=True):
                    row = {"doc_id": d, "a_ids": [], "b_ids": [], "a_ends": [], "b_ends": []}
                    w = own.sizes[np.array(places, np.int64)]
                    if len(w) and (w[:, 2] >= 0).all():
                        groups = runs(w[:, 3], w[:, 2])
                        for k, (side, held) in enumerate((("a", own.a_ids), ("b", own.b_ids))):
                            row[f"{side}_ids"] = held.held[runs(w[:, 4 + k], w[:, k])]
                            ends = (own.a_ends, own.b_ends)[k].held[groups]
                            row[f"{side}_ends"] = ends + np.repeat(np.cumsum(w[:, k]) - w[:, k], w[:, 2])
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def id_links(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, links, best) over all of align()'s rows; best: no other a_id has more links with this b_id."""
    ends = F.arrays_zip("a_ends", "b_ends")
    last = aligned.select("a_ids", "b_ids", F.explode(ends).alias("e")).select(F.element_at("a_ids", F.col("e.a_ends")).alias("a_id"), F.element_at("b_ids", F.col("e.b_ends")).alias("b_id"))
    counts = last.groupBy("a_id", "b_id").agg(F.count("*").alias("links"))
    top = counts.groupBy("b_id").agg(F.max("links").alias("most"))
    return counts.join(top, "b_id").select("a_id", "b_id", "links", (F.col("links") == F.col("most")).alias("best"))


class _Part:
    """Documents of one part, to be packed: their links become places in the part's list of pairs."""

    def __init__(self):
        self.docs, self.sizes, self.digests, self.links, self.n = [], [], [], [], 0

    def add(self, doc: int | None, sizes: tuple[int, int, int], digest: bytes, links: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append((doc is not None, *sizes, bool(digest)))
        self.digests.append(digest or bytes(32))
        self.links.append(links)
        self.n += len(links)

    def packed(self, part: int) -> dict:
        pairs, places, counts = np.unique(np.concatenate(self.links), return_inverse=True, return_counts=True)
        narrow = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
        return {
            "part": part,
            "docs": np.array([d or 0 for d in self.docs], np.int64).tobytes(),
            "sizes": np.array(self.sizes, np.int64).tobytes(),
            "digests": b"".join(self.digests),
            "places": places.astype(narrow).tobytes(),
            "pairs": pairs,
            "counts": counts,
        }


def digest(docs: DataFrame, a_file: str, b_file: str, part_links: int = PART) -> DataFrame:
    """For every document: tokens, groups and links; how many links are their B id's best; the links' summed counts;
    the digest of its groups."""

    packed_schema = pa.schema([("part", pa.int64()), *[(n, pa.binary()) for n in ("docs", "sizes", "digests", "places")], ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def pack(rows):
        own, part = aligner(a_file, b_file), _Part()
        number = TaskContext.get().partitionId() << 32
        for batch in rows:
            for ids, texts in _texts(batch):
                for d, places in zip(ids, own.walk(texts), strict=True):
                    at = np.array(places, np.int64)
                    sizes = own.sizes[at]
                    if not len(at) or (sizes[:, 2] < 0).any():
                        part.add(d, (0, 0, 0), b"", np.zeros(0, np.int64))
                    else:
                        links = own.links.held[runs(sizes[:, 3], sizes[:, 2])]
                        text = ";".join([own.text[k] for k in places])
                        part.add(d, tuple(sizes[:, :3].sum(0)), hashlib.sha256(text.encode()).digest(), links)
                    if part.n >= part_links or len(part.docs) >= part_links:
                        yield pa.RecordBatch.from_pylist([part.packed(number)], packed_schema)
                        part, number = _Part(), number + 1
        if part.docs:
            yield pa.RecordBatch.from_pylist([part.packed(number)], packed_schema)

    parts = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, PACKED), "aligned")
    pairs = parts.select("part", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("part", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("c"))
    counts = pairs.groupBy("pair").agg(F.sum("c").alias("links"))
    b_id = F.col("pair") % SIDES
    top = counts.groupBy(b_id.alias("b_id")).agg(F.max("links").alias("most"))
    judged = counts.withColumn("b_id", b_id).join(top, "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    back = pairs.select(F.col("part").alias("home"), "pair").join(judged, "pair")

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        own = np.asarray(right.column("pair"))
        order = np.argsort(own)
        links, best = np.asarray(right.column("links"))[order], np.asarray(right.column("best"))[order]
        (row,) = left.to_pylist()
        docs, sizes = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["sizes"], np.int64).reshape(-1, 5)
        places = np.frombuffer(row["places"], np.uint16 if len(own) <= 1 << 16 else np.uint32)
        cuts = np.concatenate(([0], np.cumsum(sizes[:, 3])))
        count_sum, n_best = (np.concatenate(([0], np.cumsum(x[places], dtype=np.int64))) for x in (links, best))
        return pa.table(
            {
                "doc_id": pa.array(docs, mask=sizes[:, 0] == 0),
                "n_a": sizes[:, 1],
                "n_b": sizes[:, 2],
                "n_groups": sizes[:, 3],
                "n_links": sizes[:, 3],
                "n_best": n_best[cuts[1:]] - n_best[cuts[:-1]],
                "count_sum": count_sum[cuts[1:]] - count_sum[cuts[:-1]],
                "groups_sha256": [row["digests"][32 * k : 32 * k + 32].hex() if ok else "" for k, ok in enumerate(sizes[:, 4])],
            }
        )

    held = parts.select("part", "docs", "sizes", "digests", "places")
    return held.groupBy("part").cogroup(back.groupBy("home")).applyInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
