"""Sets of five-word shingles of whole texts as 64-bit hashes, and their min-max signatures."""

from __future__ import annotations

import numpy as np
import xxhash

from . import store

WIDTH = 5
MEMO_WORDS = 150_000
#: Shingles that are permuted at a time.
PIECE = 4096
_WORDS: dict[bytes, int] = {}
#: Odd multipliers that tell the places within a shingle apart.
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer; a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(_GOLDEN))


_PLACES = stream(WIDTH, 7) | np.uint64(1)


def words(text: str) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) words between ASCII white space."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    get = _WORDS.get
    out = list(map(get, found))
    if None in out:
        if len(_WORDS) > MEMO_WORDS:
            _WORDS.clear()
        for i, h in enumerate(out):
            if h is None:
                h = xxhash.xxh3_64_intdigest(found[i])
                out[i] = h
                if len(found[i]) <= 64:
                    _WORDS[found[i]] = h
    return np.array(out, np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence counts as one if it is shorter; empty without words."""
    if not text:
        return np.zeros(0, np.uint64)
    store.claim("shingles", _WORDS.clear)
    w = words(text)
    if not len(w):
        return w
    places = _PLACES if width <= WIDTH else stream(width, 7) | np.uint64(1)
    n = len(w) - width + 1
    if n < 1:
        return mix((w * places[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    h = np.full(n, np.uint64(width))
    for i in range(width):
        h += w[i : i + n] * places[i]
    return np.unique(mix(h))


class MinMax:
    """Min-max signatures: each permutation gives the smallest and the largest value, so half the hashing is done.

    The smallest values of ``bands * rows / 2`` permutations make one half of the bands, the largest the other.
    """

    def __init__(self, bands: int, rows: int):
        if bands % 2:
            raise ValueError("an even number of bands is needed: half from minima, half from maxima")
        self.bands, self.rows = bands, rows
        self.multipliers = (stream(bands // 2 * rows, 11) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """All minima, then all maxima.  A permutation multiplies the upper halves of the hashes by an odd number."""
        high = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.empty((2, len(self.multipliers)), np.uint32)
        for at in range(0, len(high), PIECE):
            values = self.multipliers * high[None, at : at + PIECE]
            low, top = values.min(1), values.max(1)
            out[0] = np.minimum(out[0], low) if at else low
            out[1] = np.maximum(out[1], top) if at else top
        return out.reshape(-1)

    def keys(self, hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
        """One 64-bit key for each band, whose number is part of it, and the lowest byte of every value."""
        both = self.signature(hashes).astype(np.uint64).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
        for r in range(self.rows):
            key = mix(key ^ both[:, r]) + np.uint64(r)
        return key.view(np.int64), both.astype(np.uint8).tobytes()
