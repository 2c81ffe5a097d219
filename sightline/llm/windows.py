"""Hashes of byte windows, for whole batches of texts at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18  # bytes hashed at once; longer texts are cut into overlapping segments
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INV = pow(_BASE, -1, 1 << 64)


def _powers(b: int, n: int) -> np.ndarray:
    out = np.full(n, b, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial prefix hashes of a byte array; span() gives the hash of any range of it, alike for equal bytes."""

    def __init__(self, seed: int = 1):
        self.lut = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.size, self.up, self.down = 0, None, None

    def load(self, buf: np.ndarray) -> None:
        if len(buf) + 1 > self.size:
            self.size = max(len(buf) + 1, SEGMENT + 256)
            self.up, self.down = _powers(_BASE, self.size), _powers(_INV, self.size)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.lut[buf] * self.up[: len(buf)], out=self.sums[1:])

    def span(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours (van Herk), len(x) - w + 1 values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def segments(offsets: np.ndarray, overlap: int):
    """(first text, last text + 1, from byte, to byte): whole texts up to SEGMENT bytes, or parts of one long text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= SEGMENT + overlap:
            yield i, j, lo, hi
        else:
            for at in range(lo, hi - overlap, SEGMENT):
                yield i, j, at, min(hi, at + SEGMENT + overlap)
        i = j
