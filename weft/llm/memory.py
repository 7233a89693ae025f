"""Ids of words that were met before, kept in arrays: no Python object for each word of a text.

A word is a range of bytes, known by a 64-bit hash of them (a polynomial from prefix sums, mixed
with its length). Words longer than LONG bytes aren't remembered but learned each time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from weft.llm.common import mix64

LONG = 256
#: Words that are remembered; beyond it only those that were met again since the last time stay.
MOST = 1_500_000

_U = np.uint64
_rng = np.random.Generator(np.random.Philox(key=4021))
_BASE = _U(_rng.integers(0, 2**63) * 2 + 1)
_BYTES = (_rng.integers(0, 2**63, 256) * 2 + 1).astype(_U)
_POWERS: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _U(pow(int(_BASE), -1, 2**64)))):
            p = np.full(max(n, 1 << 19), base, dtype=_U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


class Memory:
    """learn takes distinct words and returns their ids one after another, and how many each has."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = MOST):
        self.learn, self.most = learn, most
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(0, _U), np.zeros(0, _U)]  # sorted hashes: many old ones, some new ones
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.n, self.filled = 0, 0
        self.start, self.size, self.again = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.ids = np.zeros(4096, np.uint32)

    def _forget(self) -> None:
        """Keep the words that were met again, if these are half of the memory at most."""
        keys, rows = np.concatenate(self.keys), np.concatenate(self.rows)
        stay = self.again[rows]
        keys, rows = keys[stay], rows[stay]
        start, size, ids = self.start[rows], self.size[rows], self.ids
        self.clear()
        if len(keys) <= self.most // 2:
            self._add(keys, gather(ids, start, size), size)

    def _add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Rows of new words."""
        n, m = self.n + len(keys), self.filled + len(ids)
        for name, most in (("start", n), ("size", n), ("again", n), ("ids", m)):
            old = getattr(self, name)
            if len(old) < most:
                new = np.zeros(max(most, 3 * len(old) // 2), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        rows = np.arange(self.n, n)
        self.start[rows], self.size[rows], self.again[rows] = self.filled + np.cumsum(size) - size, size, False
        self.ids[self.filled : m] = ids
        self.n, self.filled = n, m
        self._merge(1, keys, rows)
        if len(self.keys[1]) > max(50_000, len(self.keys[0]) // 4):
            self._merge(0, self.keys[1], self.rows[1])
            self.keys[1], self.rows[1] = np.zeros(0, _U), np.zeros(0, np.int64)
        return rows

    def _merge(self, k: int, keys: np.ndarray, rows: np.ndarray) -> None:
        keys, rows = np.concatenate([self.keys[k], keys]), np.concatenate([self.rows[k], rows])
        order = np.argsort(keys, kind="stable")
        self.keys[k], self.rows[k] = keys[order], rows[order]

    def _learned(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.learn(words) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def encode(self, data: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words data[a:b], one after another, and how many each word has."""
        if not len(a):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.n > self.most:
            self._forget()
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[: len(data)], out=sums[1:])
        key = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(_U))
        long = np.flatnonzero(b - a > LONG)
        key[long] = np.arange(len(long), dtype=_U)  # apart from each other; whatever else has these hashes is learned anew as well
        known, first, where = np.unique(key, return_index=True, return_inverse=True)
        row = np.full(len(known), -1, np.int64)
        for keys, rows in zip(self.keys, self.rows, strict=True):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, known), len(keys) - 1)
                hit = np.flatnonzero((keys[at] == known) & (known >= len(long)))
                row[hit] = rows[at[hit]]
        self.again[row[row >= 0]] = True
        new = np.flatnonzero(row < 0)
        starts, ends = a[first[new]].tolist(), b[first[new]].tolist()
        keep = known[new] >= len(long)
        ids, size = self._learned([data[x:y] for x, y in zip(starts, ends, strict=True)])
        if not keep.all():  # long words are used once, behind all that is remembered
            begin = np.cumsum(size) - size
            row[new[keep]] = self._add(known[new][keep], gather(ids, begin[keep], size[keep]), size[keep])
            more = gather(ids, begin[~keep], size[~keep])
            n, m = self.n, self.filled
            row[new[~keep]] = n + np.arange(int((~keep).sum()))
            start = np.concatenate([self.start[:n], m + np.cumsum(size[~keep]) - size[~keep]])
            sizes, store = np.concatenate([self.size[:n], size[~keep]]), np.concatenate([self.ids[:m], more])
        else:
            row[new] = self._add(known[new], ids, size)
            start, sizes, store = self.start, self.size, self.ids
        each = row[where]
        return gather(store, start[each], sizes[each]), sizes[each]


def gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """ids[start : start + size] of all ranges, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(start - (ends - size), size) + np.arange(total)]
