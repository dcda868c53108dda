"""Ragged numpy helpers over Arrow text: slices of bounded size, word bounds, word and shingle hashes.

All of it works on UTF-8 bytes, so whole texts of any length are handled; a null text is an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def give_back() -> None:
    """Hand freed memory back to the system: a worker that is kept for later tasks holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A lookup table that is True for the byte ranges, ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of words: all but ASCII white space; and letters, digits and all that isn't ASCII.
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_table(lower: bool) -> np.ndarray:
    t = mix((np.arange(1, 257, dtype=np.uint64)) * _P)
    if lower:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


class Powers:
    """Powers of an odd multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, SLICE_BYTES), _P)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, SLICE_BYTES), _P_INVERSE)]))
        return self.up, self.down


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string array; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if offsets else np.zeros(len(texts) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about ``most`` bytes; a longer text stands alone."""
    data, at = text_buffers(texts)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def word_bounds(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``data``, and for each text the number of its first word (one more entry at the end)."""
    m = inside[data]
    before, after = np.zeros_like(m), np.zeros_like(m)
    before[1:], after[:-1] = m[:-1], m[1:]
    edges = at[1:-1]
    before[edges[edges < len(m)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers, lower: bool) -> np.ndarray:
    """A 64-bit hash of each span of bytes (A-Z as a-z, if lower), from running sums of a polynomial."""
    up, down = powers.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_table(lower)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive word hashes within each text, and each text's first one.

    A text of fewer words, but not none, gives its whole sequence as one.
    """
    n = np.diff(first)
    out_n = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_first = np.concatenate([[0], np.cumsum(out_n)])
    text = np.repeat(np.arange(len(n)), out_n)
    at = np.arange(out_first[-1]) - out_first[text] + first[text]
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    short = n[text] < width
    for k in range(width):
        part = padded[at + k]
        if short.any():
            part = np.where(short & (k >= n[text]), np.uint64(0), part)
        h = (h + part + np.uint64(k + 1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h), out_first
