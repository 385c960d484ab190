"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

A text is one unit after another: leading spaces and a word, or a newline; a unit of over `LONGEST` characters (text
without spaces) is cut every `LONGEST`. No piece crosses units, so the lattice of the text is the chain of its units'
lattices. Their edges are the vocabulary's pieces and the bytes of characters that no piece covers. A unigram model's
scores are their log weights. A BPE model has no such scores, only ranks of merges (0, -1, -2, ...), of which Zipf's
law makes log weights, -log(rank + 10). Backward sums over each distinct unit's lattice give, at each place, the exact
probability of every next piece.

The `k` segmentations of a text with the largest Gumbel-perturbed log probabilities are found by A* search from the
top down: a sampled path splits the rest of the space into subtrees, one for each step (the same pieces up to there,
another piece next). A subtree's exact bound is the largest perturbed value in it: a Gumbel value of its mass, cut off
at the value found last, which bounds all unopened subtrees alike. So the largest bound of the open list is one Gumbel
value of the list's summed mass, and the subtree that has it is drawn by mass. That one is opened next: another piece
at its turn, and from there a path down to the end. The segmentations come out in order, without replacement. The
largest bound left unopened is the threshold of the inclusion probability 1 - exp(-exp(log_prob - threshold)) of each.
All draws come from hashes of the row's key, so a task that runs again draws the same.

A task remembers the lattices of up to `REMEMBERED` characters of units, and holds `FLUSH` units or `FLUSH_BYTES` of
texts at a time, or one text if that is longer; a character of distinct units takes some 60 bytes, and a step 40.

Defined results: null and empty texts have one segmentation without pieces, of log probability 0; a text with fewer
than k segmentations gives all it has, with inclusion 1; repeated rows, and rows without a doc_id with equal texts,
draw alike; an empty table gives no rows; columns but doc_id and text are not read. Decoding gives back the text byte
for byte.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, texts

SPACE = "▁"
UNIT = re.compile(r"\n| *[^ \n]+| +")
BASE = np.uint64(0x9E3779B97F4A7C15)
LONGEST, REMEMBERED, FLUSH, FLUSH_BYTES, BUILD = 1024, 1_000_000, 100_000, 1_500_000, 200_000
ENCODED = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, inclusion double, round_trip boolean, ids array<int>"
#: Where the draws of an operation begin; a step of a walk, and a round of the search, are added.
WALK, ROOT, NEXT, OWNER, TURN, PIECE = (k << 40 for k in range(6))


class Vocabulary:
    """The pieces of a SentencePiece model, and a hash table of their prefixes."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in plain}
        # units end before a space that follows something else, and around newlines
        pieces = {p: i for p, i in pieces.items() if "\n" not in p and SPACE not in p.lstrip(SPACE)}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.longest = max(map(len, pieces))
        score = np.array([sp.get_score(i) for i in range(n)])
        merges = not (score % 1).any()  # ranks of merges, not log probabilities
        self.weight = np.append(-np.log(10.0 - score), -2 * np.log(n + 10.0)) if merges else np.append(score, score.min() - 10.0)  # the last is a byte's
        self.bytes = [b""] * n
        for p, i in pieces.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        known: dict[int, int] = {}
        for p, i in pieces.items():
            h = 0
            for k, c in enumerate(p):
                h = self._step(h, ord(c))
                if k + 1 < len(p):
                    known.setdefault(h, -1)
            known[h] = i
        keys, ids = np.array(list(known), np.uint64), np.array(list(known.values()), np.int32)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.chain = int(np.diff(self.first).max())

    @staticmethod
    def _step(h: int, c: int) -> int:
        x = ((h ^ c) * int(BASE)) & (2**64 - 1)
        return x ^ (x >> 29)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a proper prefix of a piece, -2 for neither."""
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -2, np.int32)
        for k in range(self.chain):
            ok = at + k < end
            if not ok.any():
                break
            i = np.where(ok, at + k, 0)
            hit = ok & (self.keys[i] == h)
            out[hit] = self.ids[i[hit]]
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each of the runs of ids, without the space put before a text."""
        flat, cuts = self._flat(ids, counts)
        return [flat[b + 1 : e] for b, e in zip(cuts[:-1], cuts[1:], strict=True)]

    def spell(self, ids: np.ndarray, counts: np.ndarray, own: list[bytes]) -> list[bool]:
        """Whether each run of ids decodes to its own text."""
        flat, cuts = self._flat(ids, counts)
        if flat == b"".join([b" " + t if t else b"" for t in own]) and np.array_equal(np.diff(cuts), [len(t) + bool(t) for t in own]):
            return [True] * len(own)
        return [flat[b + 1 : e] == t for b, e, t in zip(cuts[:-1], cuts[1:], own, strict=True)]

    def _flat(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, list[int]]:
        size = self.sizes[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        return self.flat[spans(self.offsets[ids], size)].tobytes(), total[np.concatenate(([0], np.cumsum(counts)))].tolist()


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of every run of a size from a start on, run after run."""
    end = np.cumsum(sizes)
    return np.repeat(starts - end + sizes, sizes) + np.arange(end[-1] if len(end) else 0)


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    x = mix(key + np.uint64((salt * int(BASE) + 1) & (2**64 - 1)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class Lattices(dict):
    """Distinct units to the places of their first characters. A place has `many` options from `first` on, the longest
    piece first; an option has its piece (-1: the character's bytes), size, log probability, whether it ends the unit,
    and the sum of probabilities up to it (the last: 2)."""

    COLUMNS = {"chars": np.int32, "first": np.int32, "many": np.uint8}
    OPTIONS = {"piece": np.int32, "size": np.uint8, "logp": np.float32, "upto": np.float32, "place": np.int32, "ends": np.bool_}

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.n = self.built = self.n_options = 0
        self.at = {k: np.zeros(1 << 16, t) for k, t in (self.COLUMNS | self.OPTIONS).items()}

    def __missing__(self, unit: str) -> int:
        place = self[unit] = self.n
        self.n += len(unit)
        self.new.append(unit)
        return place

    def read(self, text: str) -> np.ndarray:
        """The places of a text's units, which build() then has to complete."""
        units = UNIT.findall(text)
        if len(text) > LONGEST and max(map(len, units)) > LONGEST:
            units = [u[k : k + LONGEST] for u in units for k in range(0, len(u), LONGEST)]
        return np.fromiter(map(self.__getitem__, units), np.int64, len(units))

    def build(self) -> None:
        held, size = [], 0
        for u in [*self.new, None]:
            if held and (u is None or size >= BUILD):
                self._build(held)
                held, size = [], 0
            if u is not None:
                held.append(u)
                size += len(u)
        self.new = []

    def _put(self, names: dict, base: int, parts: dict) -> None:
        for name in names:
            a, x = self.at[name], parts[name]
            if base + len(x) > len(a):
                self.at[name] = a = np.concatenate((a[:base], np.zeros(max(len(x), base), a.dtype)))
            a[base : base + len(x)] = x

    def _build(self, units: list[str]) -> None:
        voc = self.voc
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = np.where(chars == 32, ord(SPACE), np.where(chars == ord(SPACE), 0x110000, chars)).astype(np.uint64)
        size = np.array(list(map(len, units)), np.int64)
        n = len(chars)
        left = np.repeat(np.cumsum(size), size) - np.arange(n)  # in the unit, from here on
        at, h, parts = np.arange(n), np.zeros(n, np.uint64), []
        bare = np.ones(n, bool)
        for k in range(voc.longest):
            x = (h ^ code[at + k]) * BASE
            h = x ^ (x >> np.uint64(29))
            got = voc.find(h)
            full = np.flatnonzero(got >= 0)
            parts.append((k + 1, at[full], got[full], voc.weight[got[full]]))
            if not k:
                bare[at[full]] = False
            go = np.flatnonzero((got > -2) & (left[at] > k + 1))
            at, h = at[go], h[go]
            if not len(at):
                break
        bare = np.flatnonzero(bare)
        parts.append((1, bare, np.full(len(bare), -1), voc.weight[-1] * _n_bytes(chars[bare])))
        many = sum((np.bincount(p, minlength=n) for _, p, *_ in parts), np.zeros(n, np.int64))
        by_left = np.argsort(left, kind="stable")  # options go by how much of the unit is left, then by place
        first = np.empty(n, np.int64)
        first[by_left] = np.cumsum(many[by_left]) - many[by_left]
        free, m = first.copy(), int(many.sum())
        piece, step, place, value = np.empty(m, np.int32), np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m)
        for k, p, got, w in reversed(parts):
            to = free[p]
            free[p] += 1
            piece[to], step[to], place[to], value[to] = got, k, p, w
        ends = step == left[place]
        beta, logp = np.zeros(n + voc.longest + 1), np.empty(m)
        cut = np.searchsorted(left[by_left], np.arange(1, (left.max() if n else 0) + 2))
        for b, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b == e:
                continue
            p = by_left[b:e]
            o = slice(first[p[0]], first[p[-1]] + many[p[-1]])
            v = value[o] + np.where(ends[o], 0.0, beta[place[o] + step[o]])
            runs, count = first[p] - first[p[0]], many[p]
            top = np.maximum.reduceat(v, runs)
            v -= np.repeat(top, count)
            total = np.log(np.add.reduceat(np.exp(v), runs))
            beta[p] = top + total
            logp[o] = v - np.repeat(total, count)
        upto = np.cumsum(np.exp(logp))
        head = first[place]
        upto -= np.where(head > 0, upto[head - 1], 0.0)
        upto[(first + many)[place] - 1 == np.arange(m)] = 2.0
        self._put(self.OPTIONS, self.n_options, {"piece": piece, "size": step, "logp": np.minimum(logp, 0.0), "upto": upto, "place": place + self.built, "ends": ends})
        self._put(self.COLUMNS, self.built, {"chars": chars, "first": first + self.n_options, "many": many})
        self.built += n
        self.n_options += m

    def walk(self, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each place to its unit's end: how many options each walker takes, and all of them, in order."""
        first, size, upto, ends = (self.at[c] for c in ("first", "size", "upto", "ends"))
        who, place, steps, n = np.arange(len(place)), place, [], len(place)
        while len(who):
            u = _uniform(key, WALK + len(steps)).astype(np.float32)
            o = first[place]
            on = np.flatnonzero(u >= upto[o])
            while len(on):
                o[on] += 1
                on = on[u[on] >= upto[o[on]]]
            steps.append((who, o))
            go = np.flatnonzero(~ends[o])
            who, place, key = who[go], (place + size[o])[go], key[go]
        count = np.zeros(n, np.int64)
        for w, _ in steps:
            count[w] += 1
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for k, (w, o) in enumerate(steps):
            out[begin[w] + k] = o
        return count, out


def _n_bytes(chars: np.ndarray) -> np.ndarray:
    return np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))


class Paths:
    """A segmentation of each of some documents: its options and the tokens that they lie in, document after document;
    its log probability and perturbed value; and, for each step, the mass of the unopened subtrees beside it."""

    def __init__(self, lat: Lattices, n: int, doc: np.ndarray, opt: np.ndarray, token: np.ndarray, bounds: np.ndarray, since: np.ndarray, perturbed: np.ndarray):
        self.lat, self.doc, self.opt, self.token, self.bounds, self.perturbed = lat, doc, opt, token, bounds, perturbed
        self.row = np.full(n, -1)
        self.row[doc] = np.arange(len(doc))
        logp = lat.at["logp"][opt].astype(np.float64)
        total = np.concatenate(([0.0], np.cumsum(logp)))
        self.log_prob = total[bounds[1:]] - total[bounds[:-1]]
        sizes = np.diff(bounds)
        self.before = total[:-1] - np.repeat(total[bounds[:-1]], sizes)
        self.mass = np.exp(self.before) * -np.expm1(logp)
        self.mass[spans(bounds[:-1], np.minimum(since, sizes))] = 0.0
        self.barred = np.zeros(len(opt), np.int64)  # options of a step, as bits, besides its own, that were opened

    def total(self) -> np.ndarray:
        out = np.zeros(len(self.doc))
        full = np.flatnonzero(np.diff(self.bounds) > 0)
        if len(full):
            out[full] = np.add.reduceat(self.mass, self.bounds[:-1][full])
        return out

    def pick(self, row: np.ndarray, total: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A step of each of the rows, drawn by mass."""
        sizes = np.diff(self.bounds)[row]
        at = spans(self.bounds[:-1][row], sizes)
        share = np.cumsum(self.mass[at] / np.repeat(total, sizes))
        end = np.cumsum(sizes)
        low = np.where(end > sizes, share[end - sizes - 1], 0.0)
        found = np.clip(np.searchsorted(share, low + u * (share[end - 1] - low), "right"), end - sizes, end - 1)
        step = at[found]
        for k in np.flatnonzero(self.mass[step] <= 0).tolist():  # by rounding
            step[k] = self.bounds[row[k]] + self.mass[self.bounds[row[k]] : self.bounds[row[k] + 1]].argmax()
        return step

    def turn(self, step: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Another option at each of the steps, drawn by probability; it is barred from now on."""
        at = self.lat.at
        own = self.opt[step]
        head = at["first"][at["place"][own]]
        many = at["many"][at["place"][own]].astype(np.int64)
        rank = np.arange(int(many.max()))
        p = np.exp(at["logp"][np.minimum(head[:, None] + rank, self.lat.n_options - 1)].astype(np.float64))
        p[(rank >= many[:, None]) | (rank == (own - head)[:, None]) | ((self.barred[step][:, None] >> rank) & 1 == 1)] = 0.0
        upto = np.cumsum(p, axis=1)
        got = np.minimum((upto <= (u * upto[:, -1])[:, None]).sum(axis=1), len(rank) - 1)
        each = np.arange(len(step))
        got = np.where(p[each, got] > 0, got, p.argmax(axis=1))
        left = p.sum(axis=1) - p[each, got]
        p[each, got] = 0.0
        left[~(p > 0).any(axis=1)] = 0.0
        self.mass[step] = np.exp(self.before[step]) * left
        self.barred[step] |= np.left_shift(1, got)
        return (head + got).astype(np.int32)


def sample(lat: Lattices, place: np.ndarray, bounds: np.ndarray, key: np.ndarray, k: int) -> tuple[list[Paths], np.ndarray]:
    """For documents given as runs of places of units: up to k Paths, the j-th of the documents that have a j-th
    segmentation, and the threshold of each document."""
    n = len(bounds) - 1
    number = np.arange(len(place)) - np.repeat(bounds[:-1], np.diff(bounds))  # draws go by the token's number in its text

    def keys(doc, number, j):
        return mix(mix(key + np.uint64(j))[doc] + number.astype(np.uint64) * BASE)

    count, opt = lat.walk(place, keys(np.repeat(np.arange(n), np.diff(bounds)), number, 0))
    ends = np.concatenate(([0], np.cumsum(count)))
    token = np.repeat(np.arange(len(place), dtype=np.int32), count)
    value = -np.log(-np.log(_uniform(key, ROOT)))
    pool = [Paths(lat, n, np.arange(n), opt, token, ends[bounds], np.zeros(n, np.int64), value)]
    for j in range(1, k + 1):
        mass = np.zeros((len(pool), n))
        for x, m in zip(pool, mass, strict=True):
            m[x.doc] = x.total()
        total = mass.sum(axis=0)
        some = np.flatnonzero(total > 0)
        bound, value = value, np.full(n, -np.inf)
        value[some] = -np.logaddexp(-bound[some], -(np.log(total[some]) - np.log(-np.log(_uniform(key[some], NEXT + j)))))
        if j == k or not len(some):
            return pool, value
        doc, own = some, mass[:, some]
        owner = np.minimum((np.cumsum(own, axis=0) <= _uniform(key[doc], OWNER + j) * total[doc]).sum(axis=0), len(pool) - 1)
        owner = np.where(own[owner, np.arange(len(doc))] > 0, owner, own.argmax(axis=0))
        step, turn, kept, at = (np.zeros(len(doc), np.int64) for _ in range(4))
        for q, x in enumerate(pool):
            i = np.flatnonzero(owner == q)
            if len(i):
                row = x.row[doc[i]]
                step[i] = x.pick(row, own[q, i], _uniform(key[doc[i]], TURN + j))
                turn[i] = x.turn(step[i], _uniform(key[doc[i]], PIECE + j))
                kept[i] = step[i] - x.bounds[row]
                at[i] = x.token[step[i]]
        # the rest of the turn's unit, and all units after it
        head = (~lat.at["ends"][turn]).astype(np.int64)
        tail = bounds[doc + 1] - at - 1
        begin = np.cumsum(head + tail) - head - tail
        tokens = np.empty(int((head + tail).sum()), np.int64)
        tokens[begin[head > 0]] = at[head > 0]
        tokens[spans(begin + head, tail)] = spans(at + 1, tail)
        places = place[tokens]
        places[begin[head > 0]] = (lat.at["place"][turn] + lat.at["size"][turn])[head > 0]
        count, rest = lat.walk(places, keys(np.repeat(doc, head + tail), number[tokens], j))
        each = np.concatenate(([0], np.cumsum(count)))
        n_rest = each[begin + head + tail] - each[begin]
        ends = np.concatenate(([0], np.cumsum(kept + 1 + n_rest)))
        opt, token = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.int32)
        for q, x in enumerate(pool):
            i = np.flatnonzero(owner == q)
            to, of = spans(ends[i], kept[i]), spans(x.bounds[x.row[doc[i]]], kept[i])
            opt[to], token[to] = x.opt[of], x.token[of]
        opt[ends[:-1] + kept], token[ends[:-1] + kept] = turn, at
        to = spans(ends[:-1] + kept + 1, n_rest)
        opt[to], token[to] = rest, np.repeat(tokens, count)
        pool.append(Paths(lat, n, doc, opt, token, ends, kept + 1, value[doc]))
    return pool, value


def _ids(lat: Lattices, x: Paths) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the paths, bytes spelled out, and how many each document has."""
    piece = lat.at["piece"][x.opt]
    bare = np.flatnonzero(piece < 0)
    if not len(bare):
        return piece, np.diff(x.bounds)
    chars = lat.at["chars"][lat.at["place"][x.opt[bare]]].astype(np.int64)
    size = _n_bytes(chars)
    n = np.ones(len(piece), np.int64)
    n[bare] = size
    at = np.concatenate(([0], np.cumsum(n)))
    ids = np.empty(at[-1], np.int32)
    ids[at[:-1]] = piece
    left = np.repeat(size, size) - spans(np.zeros(len(size), np.int64), size) - 1  # bytes that follow
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    byte = np.repeat(chars, size) >> (6 * left)
    byte = np.where(left == np.repeat(size, size) - 1, np.repeat(lead, size) | byte, 0x80 | (byte & 0x3F))
    ids[spans(at[:-1][bare], size)] = lat.voc.byte_ids[byte]
    return ids, np.diff(at[x.bounds])


def _encode(held: list[tuple[int | None, bytes]], lat: Lattices, k: int, seed: int):
    runs = [lat.read(" " + t.decode()) if t else np.zeros(0, np.int64) for _, t in held]
    lat.build()
    keys = mix(np.array([0 if d is None else d for d, _ in held], np.int64).view(np.uint64) + np.uint64(seed))
    found, threshold = sample(lat, np.concatenate(runs), np.concatenate(([0], np.cumsum(list(map(len, runs))))), keys, k)
    for rank, x in enumerate(found):
        ids, counts = _ids(lat, x)
        own = [held[i] for i in x.doc.tolist()]
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(x.log_prob - threshold[x.doc]))
        ends = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in own], pa.int64()), pa.array(np.full(len(own), rank, np.int32)), pa.array(counts.astype(np.int64)), pa.array(x.log_prob), pa.array(x.perturbed), pa.array(inclusion),
             pa.array(lat.voc.spell(ids, counts, [t for _, t in own])), pa.ListArray.from_arrays(ends, pa.array(ids))],
            names=["doc_id", "rank", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip", "ids"])
    if lat.n > REMEMBERED:
        lat.forget()


def encode(docs: DataFrame, model_file: str, k: int = 2, seed: int = 1) -> DataFrame:
    """ENCODED: up to k segmentations of every text, rank 0 with the largest perturbed value. The vocabulary, whose
    size is the model's, goes to the executors once."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    def run(it):
        lat, held, size = Lattices(shared.value), [], 0
        for batch in it:
            for d, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                held.append((d, t))
                size += max((t.count(b" ") + t.count(b"\n") + 1) / FLUSH, len(t) / FLUSH_BYTES)
                if size >= 1:
                    yield from _encode(held, lat, k, seed)
                    held, size = [], 0
        if held:
            yield from _encode(held, lat, k, seed)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """encoded with the text of its ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    def run(it):
        for batch in it:
            ids = batch.column("ids")
            counts = np.array([0 if c is None else c for c in ids.value_lengths().to_pylist()], np.int64)
            out = shared.value.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, schema + ", text string")
