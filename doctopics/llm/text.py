"""Vectorised byte and word kernels for Arrow batches; they keep no state between batches.

Texts are handled as UTF-8 bytes. Words are maximal runs of bytes other than space and 0x09-0x0D, as ``bytes.split()``
has them. Hashes are polynomials modulo 2**64 over seeded random byte values, finished by a bijective mixer, so the
hash of any window comes from two prefix sums whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) <= 4 * CHUNK_BYTES:  # one huge text must not pin its table
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text (a longer text stands alone), so that memory is bounded by the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and its n + 1 offsets; nulls are empty."""
    wide = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = wide.cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray, word_byte: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets of the texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = word_byte[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    firsts = offs[:-1][offs[:-1] < len(data)]
    before[firsts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[firsts[firsts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(inverse(BASE), n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``length`` words and whether it lies within its text; one entry per word."""
    n = len(words)
    sums = np.zeros(n + length + 1, np.uint64)
    np.cumsum(words * powers(WORD_BASE, n), out=sums[1 : n + 1])
    sums[n + 1 :] = sums[n]
    at = np.arange(n)
    raw = (sums[at + length] - sums[at]) * powers(inverse(WORD_BASE), n + 1)[:n]
    return mix(raw + np.uint64(length)), at + length <= np.repeat(offs[1:], np.diff(offs))


def owners(offs: np.ndarray) -> np.ndarray:
    """Which text each word (or byte) belongs to."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions some window of ``length`` from ``starts`` covers."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + length, n), -1)
    return np.cumsum(edges[:n]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
