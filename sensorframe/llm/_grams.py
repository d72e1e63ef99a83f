"""Hashes of words and word n-grams, a text at a time in numpy; used inside tasks."""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 18  # texts are hashed in blocks of about this many bytes, cut between words
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[i] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(raw: bytes) -> bytes:
    """A-Z lower-cased, words parted by one space; bytes methods know ASCII letters and the six ASCII blanks only."""
    return b" ".join(raw.lower().split())


def _block(words: bytes) -> np.ndarray:
    at = np.frombuffer(words, np.uint8)
    power, inverse = _power(len(at) + 1)
    run = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(_TABLE[at] * power[:-1], out=run[1:])
    gaps = np.flatnonzero(at == 32)
    start = np.concatenate(([0], gaps + 1))
    end = np.concatenate((gaps, [len(at)]))
    return mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    words, out, at = normal(raw), [], 0
    while at < len(words):
        cut = words.find(b" ", at + _BLOCK)
        cut = len(words) if cut < 0 else cut
        out.append(_block(words[at:cut]))
        at = cut + 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def ngrams(words: np.ndarray, n: int, whole_if_short: bool = True) -> np.ndarray:
    """A hash of each run of ``n`` words; of the whole sequence where it is shorter; nothing of no words."""
    if len(words) < n:
        n = len(words) if whole_if_short else 0
    if not n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    out = words[:m] + np.uint64(n)
    for k in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + m]
    return mix(out)
