"""64-bit hashes of words and word windows, vectorised over one document."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE2 = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word (two rounds of multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int = _BASE):
        self._base, self._inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def ready(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            ones = np.full(size, self._base, dtype=np.uint64)
            ones[0] = 1
            self.up = np.cumprod(ones)
            ones = np.full(size, self._inverse, dtype=np.uint64)
            ones[0] = 1
            self.down = np.cumprod(ones)


class WindowHasher:
    """Rolling polynomial hashes of word windows; two independent ones give 128 bits."""

    def __init__(self):
        self._powers = (Powers(_BASE), Powers(_BASE2))

    def prefixes(self, hashes: np.ndarray, which: int = 0) -> np.ndarray:
        powers = self._powers[which]
        powers.ready(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers.up[: len(hashes)], out=out[1:])
        return out

    def spans(self, prefixes: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the word spans [start, stop), from the prefix sums."""
        return mix((prefixes[stop] - prefixes[start]) * self._powers[which].down[start])

    def windows(self, hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
        p = self.prefixes(hashes, which)
        n = len(hashes) - width + 1
        return mix((p[width:] - p[:n]) * self._powers[which].down[:n])
