"""Vectorised hashing of words, shingles and byte windows inside tasks.

A batch of texts is one byte buffer with row offsets. Polynomial prefix sums
give the hash of any byte range in constant time, so no Python code runs per
word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit scrambling (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype="uint64") * _BASE + np.uint64(seed))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base, or of its inverse, modulo 2**64."""
    known = _powers.get(inverse)
    if known is None or len(known) < n:
        factors = np.full(max(n, 1 << 20), _INVERSE if inverse else _BASE)
        factors[0] = 1
        known = _powers[inverse] = np.multiply.accumulate(factors)
    return known[:n]


def prefix_hash(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero; ``(s[b] - s[a]) * inverse[a]`` is the hash of bytes a to b."""
    sums = np.zeros(len(data) + 1, "uint64")
    np.cumsum(table[data] * powers(len(data)), out=sums[1:])
    return sums


def text_chunks(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of whole texts, about ``limit`` bytes at a time; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + n + 1] if n else np.zeros(1, "int64")
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        part = offsets[lo : hi + 1]
        yield lo, data[part[0] : part[-1]], part - part[0]
        lo = hi


# Words: maximal runs of bytes other than the space and tab to carriage return.
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD_TABLE = numbers(11, 256)[_LOWER]


def spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray = _SOLID) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of solid bytes, which end with their text."""
    if not len(data):
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    good = solid[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = good.copy(), good.copy()
    first[1:] &= ~good[:-1] | edge[1:-1]
    last[:-1] &= ~good[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of the lower-cased bytes of every span."""
    sums = prefix_hash(data, _WORD_TABLE)
    raw = (sums[b] - sums[a]) * powers(len(data) + 1, inverse=True)[a]
    return mix(raw + (b - a).astype("uint64") * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every lower-cased word, and how many words each text has."""
    a, b = spans(data, offsets)
    return span_hashes(data, a, b), np.diff(np.searchsorted(a, offsets))


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(parts[0]), len(parts), "uint64")
    for part in parts:
        out = (out ^ part) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return mix(out)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its word shingles); a shorter text is one shingle, an empty one none."""
    for row, data, offsets in text_chunks(texts):
        hashes, counts = words(data, offsets)
        ends = np.cumsum(counts)
        n = len(hashes) - width + 1
        runs = _fold([hashes[k : k + n] for k in range(width)]) if n > 0 else hashes[:0]
        for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist())):
            lo = end - count
            if count >= width:
                found = np.sort(runs[lo : end - width + 1])
                keep = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield row + i, found[keep]
            elif count:
                yield row + i, _fold([hashes[lo + k : lo + k + 1] for k in range(count)])
            else:
                yield row + i, hashes[:0]
