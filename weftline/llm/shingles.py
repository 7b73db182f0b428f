"""Word shingles of whole texts as 64-bit hashes, and min-max signatures over them."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import WHITE, mix, word_hashes

WORDS = 5


def shingle_set(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``words`` words, after lower-casing A-Z; words are what white
    space of ASCII parts. A text with fewer words has one shingle, the whole sequence; one without, none."""
    w = word_hashes(raw.lower(), WHITE)
    n = len(w)
    if not n:
        return w
    size = min(n, words)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    h = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        h = h + w[i : n - size + 1 + i] * weights[i]
    return np.unique(mix(h))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell equal sets."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, count + 1, dtype=np.uint64)
    return mix(i * np.uint64(0x8CB92BA72F3D8DD7)) | np.uint64(1), mix(i * np.uint64(0xC6BC279692B5CC83))


def min_max_signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a non-empty set under each permutation: 2 x len(a) values from len(a) evaluations."""
    low = np.full(len(a), np.iinfo(np.uint64).max)
    high = np.zeros(len(a), np.uint64)
    for i in range(0, len(shingles), 4096):
        x = shingles[i : i + 4096, None] * a + b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        np.minimum(low, x.min(0), out=low)
        np.maximum(high, x.max(0), out=high)
    return np.stack([low, high], 1).ravel()


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash per band of ``rows`` values, the band's number mixed in."""
    bands = signature.reshape(-1, rows)
    h = np.arange(1, len(bands) + 1, dtype=np.uint64) * np.uint64(0x589965CC75374CC3)
    for i in range(rows):
        h = mix(h + bands[:, i])
    return h.view(np.int64)
