"""Word shingles and b-bit MinHash signatures of whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

SHINGLE_WORDS = 5
COMPONENTS = 30
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20).integers(0, 2**63, 2 * COMPONENTS, dtype=np.uint64)
_FACTORS, _SHIFTS = _SEEDS[:COMPONENTS] | np.uint64(1), _SEEDS[COMPONENTS:]
_CACHE_WORDS = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


def shingle_set(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles (of the whole sequence, if it has fewer words).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
    """
    words = text.encode().lower().split()  # bytes: lowers A-Z only, splits at exactly these characters
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    m = min(SHINGLE_WORDS, len(words))
    h = np.zeros(len(w) - m + 1, np.uint64)
    for j in range(m):
        h = mixed((h + w[j:j + len(h)]) * _STEP + np.uint64(j + 1))
    return np.unique(h + np.uint64(m < SHINGLE_WORDS) * np.uint64(m))


def digest(shingles: np.ndarray) -> bytes:
    """16 bytes that name a shingle set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> np.ndarray:
    """COMPONENTS minima under independent hash functions, 16 bits each."""
    low = np.empty(COMPONENTS, np.uint64)
    for part in range(0, len(shingles), 1 << 16):
        s = shingles[part:part + (1 << 16)]
        for i in range(COMPONENTS):
            x = s * _FACTORS[i] + _SHIFTS[i]
            m = (x ^ (x >> np.uint64(29))) * _M2
            v = m.min()
            low[i] = v if part == 0 else min(low[i], v)
    return (low >> np.uint64(16)).astype(np.uint16)
