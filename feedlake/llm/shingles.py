"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Most words whose hashes a Python worker keeps; later words are hashed again each time.
KEPT_WORDS = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64 and len(self) < KEPT_WORDS:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingle_set(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`.

    A text with fewer words has one shingle, its whole sequence; no words or null: none.
    """
    if not text:
        return np.empty(0, np.uint64)
    split = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: exactly A-Z and ASCII white space
    n = len(split)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(width, n)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, n)
    out = h[: n - width + 1] + np.uint64(width)
    for j in range(1, width):
        out = out * _P + h[j : n - width + 1 + j]
    return np.unique(mixed(out))


def set_key(values: np.ndarray) -> bytes:
    """A 128-bit name of the set; equal sets have equal names."""
    return xxhash.xxh3_128_digest(values.tobytes())


class MinHasher:
    """n 32-bit MinHash values of a set of hashes."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint64)
        for at in range(0, len(values), 4096):
            block = np.multiply.outer(self.a, values[at : at + 4096])
            block += self.b[:, None]
            np.minimum(out, block.min(axis=1) >> np.uint64(32), out=out)
        return out.astype(np.uint32)
