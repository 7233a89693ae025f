"""Words of many texts at once, as 64-bit hashes: no Python object for each word.

A word is a maximal run of bytes that aren't separators, A-Z lower-cased. Its hash is a polynomial
over its bytes, taken from prefix sums and mixed with its length. Two different words of a corpus
with w distinct ones share a hash with odds of about w * w / 2**65.
"""

from __future__ import annotations

import numpy as np

from weft.llm.common import chunks, mix64

_U = np.uint64
_rng = np.random.Generator(np.random.Philox(key=1303))
_BASE = _U(_rng.integers(0, 2**62) * 2 + 1)
_BYTES = (_rng.integers(0, 2**62, 256) * 2 + 1).astype(_U)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: ASCII other than digits and letters parts terms; all other characters belong to them.
TERM_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Characters hashed at once, or one text if that is longer.
AT_ONCE = 400_000


class WordHasher:
    def __init__(self, breaks: np.ndarray = TERM_BREAKS):
        self.breaks = breaks
        self._up = self._down = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            n = max(n, 1 << 18)
            for name, base in (("_up", _BASE), ("_down", _U(pow(int(_BASE), -1, 2**64)))):
                p = np.full(n, base, dtype=_U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, text after text, and how many each text has."""
        parts = [self._hashed([t.encode("utf-8", "surrogatepass") for t in texts[a:b]]) for a, b in chunks(texts, AT_ONCE)]
        if not parts:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])

    def _hashed(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        gap = bytes([int(np.flatnonzero(self.breaks)[0])])
        data = np.frombuffer(gap + gap.join(raw) + gap, dtype=np.uint8)
        self._powers(len(data) + 1)
        cut = self.breaks[data]
        edge = np.flatnonzero(cut[1:] != cut[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[_LOWER[data]] * self._up[: len(data)], dtype=_U)])
        words = mix64((sums[ends] - sums[starts]) * self._down[starts] + (ends - starts).astype(_U))
        limits = np.cumsum([len(r) + 1 for r in raw])
        upto = np.searchsorted(starts, limits + 1)
        return words, np.diff(np.concatenate([[0], upto]))
