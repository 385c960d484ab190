"""What several operators share: staged tables, word splitting, hashing, packed buckets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tessella.staging import shared_dir, stage, stage_by, unstage  # noqa: F401

#: A-Z to a-z; everything that is neither an ASCII letter or digit nor above 0x7F to a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Hashes(dict):
    """Word bytes to 64-bit hash, remembered; forgets all when it holds too many."""

    def __init__(self, seed: int = 0, most: int = 1_000_000):
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand, for Rabin-Karp window hashes."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up, self.down = self._table(base, 4096), self._table(self.inv, 4096)

    @staticmethod
    def _table(b: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        out[1:] = np.uint64(b)
        return np.cumprod(out, dtype=np.uint64)

    def windows(self, h: np.ndarray, n: int) -> np.ndarray:
        """Hash of every n consecutive values: sum of h[i+j] * base**-j, by differences of prefix sums."""
        m = len(h)
        if m < n:
            return np.zeros(0, np.uint64)
        if m > len(self.up):
            self.up, self.down = self._table(self.base, 2 * m), self._table(self.inv, 2 * m)
        p = np.zeros(m + 1, np.uint64)
        np.cumsum(h * self.down[:m], out=p[1:])
        return mix((p[n:] - p[:-n]) * self.up[: m - n + 1])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [b if b is not None else b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size positions lie in a window of n that begins at one of starts."""
    d = np.zeros(size + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + n, size), -1)
    return np.cumsum(d[:-1]) > 0


def bucket_count(n_items: int, per_bucket: int, least: int = 1) -> int:
    return max(least, -(-int(n_items) // per_bucket))


def by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that gathers the rows of each bucket, and the n + 1 bounds of the buckets in it."""
    if n <= 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by radix
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def batches(rows: Iterable[dict], schema: pa.Schema, most: int = 2000, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded length and size."""
    held: list[dict] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r.values() if isinstance(v, (bytes, str, list)))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
