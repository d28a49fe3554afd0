"""Hashes of word runs for whole blocks of texts at once."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(int(_RANDOM.integers(1 << 40, 1 << 62)) * 2 + 1)
_STEP = np.uint64(int(_RANDOM.integers(1 << 40, 1 << 62)) * 2 + 1)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of a sequence, given one random number for each place's sign."""
    power, inverse = _tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order (A-Z lower-cased), and the number of words per text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    joined = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    space = _SPACES[joined]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    hashes = span_hashes(_BYTE[joined], starts, ends)
    borders = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return hashes, np.diff(np.searchsorted(starts, borders))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring words of one array (empty if there are fewer)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(len(words) - k + 1, np.uint64), 1
    for j in range(k):
        total = total + words[j:len(words) - k + 1 + j] * np.uint64(factor)
        factor = factor * int(_STEP) % (1 << 64)
    return mix(total + np.uint64(k))


def sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text: its distinct k-word runs, ascending; with fewer words the whole sequence as one, without words none."""
    words, counts = word_hashes(texts)
    runs = run_hashes(words, k)  # over all texts; those that cross a border are not taken
    out, at = [], 0
    for n in counts.tolist():
        out.append(np.unique(runs[at:at + n - k + 1]) if n >= k else run_hashes(words[at:at + n], n) if n else np.zeros(0, np.uint64))
        at += n
    return out
