"""Texts of a batch as flat numpy arrays: characters, piece borders, and 64-bit hashes of pieces.

What decides a result by its hash uses :func:`mixed_hashes`, where every character is scattered with its place before
it is summed. :func:`piece_hashes` is a polynomial read off prefix sums modulo 2**64, cheaper for pieces that overlap,
but there are texts whose polynomials are equal for every base; it serves hashed features only. Memory is
bounded by ``CHUNK`` characters, or by the longest text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def trim() -> None:
    """Gives freed memory of this process back to the system: idle Python workers otherwise keep their peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(work: Callable) -> Callable:
    """A map over batches whose task leaves no freed memory behind."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        if n > 4 * CHUNK:  # a single very long text: not kept
            return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base)]))
        m = max(n, CHUNK + (CHUNK >> 2))
        have = _powers[int(base)] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, base)]))
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def piece_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]``."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers_of(_P, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers_of(_PINV, n + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _scattered(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """One pseudo-random 64-bit number per character and place."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    x += place.astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def mixed_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``values[start:end]``, pieces of at least one value that do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    offsets = offsets_of(lengths)
    if offsets[-1] != len(values):
        values = values[ragged(starts, lengths)]
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    return mix(np.add.reduceat(_scattered(values, place), offsets[:-1]) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def differing(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers of the pieces that are not equal in ``a`` and ``b``."""
    wrong = np.flatnonzero(a[ragged(a_starts, lengths)] != b[ragged(b_starts, lengths)])
    return np.unique(np.searchsorted(offsets_of(lengths), wrong, "right") - 1)


def chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``CHUNK`` characters in all; a longer text is a range of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > CHUNK:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def offsets_of(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ..`` of all ranges, one after the other."""
    total = offsets_of(lengths)
    return np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offsets of the texts."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, offsets_of([len(t) for t in texts])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def words(texts: list[bytes], hashed: Callable = mixed_hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased: hashes, first and last byte, offsets of the texts in words.

    Works on UTF-8, where the separators and A-Z are single bytes.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = offsets_of([len(t) for t in texts])
    inside = ~_WHITE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = at[:-1][np.diff(at) > 0]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[at[1:][np.diff(at) > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return hashed(_LOWER[data], starts, ends), starts, ends, np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words per text, and their offsets; a shorter text is one shingle as a whole."""
    counts = np.diff(at)
    lengths = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = ragged(at[:-1], lengths)
    sizes = np.minimum(np.repeat(at[1:], lengths) - first, width)
    sums = sizes.astype(np.uint64)
    for k in range(width):
        inside = slice(None) if len(sizes) and sizes.min() > k else np.flatnonzero(sizes > k)
        sums[inside] += mix(hashes[first[inside] + k] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return mix(sums), offsets_of(lengths)


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values per text and their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:])]
    return (np.concatenate(parts) if parts else values[:0]), offsets_of([len(p) for p in parts])
