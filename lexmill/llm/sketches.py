"""MinHash sketches of shingle sets: what the LSH forest sorts and compares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lexmill.llm.arrays import NOT_SPACE, Powers, shingle_hashes, slices, span_hashes, word_bounds

WIDTH = 5
TREES = 24
DEPTH = 8
HASHES = TREES * DEPTH
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: pa.Array, powers: Powers) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b, data, at in slices(texts):
        starts, ends, first = word_bounds(data, at, NOT_SPACE)
        if not len(starts):
            yield from (np.zeros(0, np.uint64) for _ in range(b - a))
            continue
        h, hf = shingle_hashes(span_hashes(data, starts, ends, powers, True), first, WIDTH)
        for k in range(b - a):
            own = np.sort(h[hf[k] : hf[k + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def digest(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """A 128-bit digest of a set, whatever the order."""
    return own.sum(), ((own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).sum()


def minhash(own: np.ndarray) -> np.ndarray:
    """The least value of the set under each of ``HASHES`` functions."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        v = (x[None, k : k + 2048] ^ _XOR[:, None]) * _MUL[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(1), out=out)
    return out


def sketch_batch(texts: pa.Array, powers: Powers) -> pa.StructArray:
    """Set size, a 128-bit digest of the set, a byte of each least value, and the sort keys of each tree (high and low part)."""
    n = np.zeros(len(texts), np.int64)
    digests = np.zeros((2, len(texts)), np.uint64)
    least = np.zeros((len(texts), HASHES), np.uint32)
    for k, own in enumerate(shingle_sets(texts, powers)):
        n[k] = len(own)
        if len(own):
            digests[:, k] = digest(own)
            least[k] = minhash(own)
    parts = (least & np.uint32(0xFFFF)).astype(np.uint64).reshape(len(texts), TREES, 2, DEPTH // 2)
    keys = np.zeros((len(texts), TREES, 2), np.uint64)
    for k in range(DEPTH // 2):
        keys = (keys << np.uint64(16)) | parts[..., k]
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * TREES)
    marks = ((least >> np.uint32(16)) & np.uint32(0xFF)).astype(np.uint8)
    binary = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.arange(len(texts) + 1, dtype=np.int32) * HASHES), pa.py_buffer(marks.tobytes())])
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(keys[..., j]).view(np.int64).ravel())) for j in range(2)]
    return pa.StructArray.from_arrays([pa.array(n), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), binary, *lists], ["n", "d1", "d2", "marks", "high", "low"])


SKETCH = "struct<n:bigint,d1:bigint,d2:bigint,marks:binary,high:array<bigint>,low:array<bigint>>"


def agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    """An estimate of the sets' similarity from their marks; equal bytes by chance are taken off."""
    x = np.frombuffer(b"".join(a.to_pylist()), np.uint8).reshape(-1, HASHES)
    y = np.frombuffer(b"".join(b.to_pylist()), np.uint8).reshape(-1, HASHES)
    return ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)
