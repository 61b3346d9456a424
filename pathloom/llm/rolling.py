"""Hashes of any stretch of a byte string from one pass: polynomial prefix sums modulo 2**64 over random byte codes."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
CODES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
STEP = 2_000_000


class _Powers:
    """Powers of the base and of its inverse, as far as a worker has needed them."""

    up = down = np.zeros(0, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_Powers.up) < n:
        size = -(-n // STEP) * STEP
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            seq = np.full(size, base, dtype=np.uint64)
            seq[0] = 1
            setattr(_Powers, name, np.cumprod(seq))
    return _Powers.up, _Powers.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """``at(a, z)``: the hash of bytes a to z, for arrays of bounds."""

    def __init__(self, b: np.ndarray):
        up, self.down = powers(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(CODES[b] * up[: len(b)], out=self.sums[1:])

    def at(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return mix((self.sums[z] - self.sums[a]) * self.down[a])

    def each(self, n: int) -> np.ndarray:
        """The hash of every ``n`` bytes that follow each other, without arrays of bounds."""
        out = self.sums[n:] - self.sums[:-n]
        out *= self.down[: len(out)]
        return mix(out)


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of all texts (runs of ASCII letters or digits and of anything beyond ASCII, lower-cased): hash, text number."""
    data = [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    b = np.frombuffer(b"\n".join([*data, b""]), dtype=np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.diff(_WORD[b].astype(np.int8), prepend=0)
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Rolling(b).at(a, z), np.searchsorted(np.cumsum([len(d) + 1 for d in data]), a, side="right")
