"""Numpy kernels over the UTF-8 bytes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``limit`` bytes, or one longer row; null is empty."""
    col = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(col)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and len(bufs[2]) else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)])).astype(np.uint64)


class Tokens:
    """White-space tokens, A-Z lower-cased if ``fold``, as 64-bit hashes."""

    def __init__(self, fold: bool = True) -> None:
        table = np.arange(256)
        if fold:
            table[65:91] += 32
        self.value = mix64(table.astype(np.uint64) + _ODD)
        self.inside = np.ones(256, bool)
        self.inside[[9, 10, 11, 12, 13, 32]] = False
        self.base = 0xD1342543DE82EF95
        self.inverse = pow(self.base, -1, 1 << 64)
        self.size, self.up, self.down = 0, _powers(1, 0)[:0], _powers(1, 0)[:0]

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, CHUNK + 1)
            self.up, self.down = _powers(self.base, self.size), _powers(self.inverse, self.size)

    def spans(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the tokens, and for each row the index of its first token (one more at the end)."""
        inside = self.inside[data]
        border = np.zeros(len(data) + 1, bool)
        border[offs] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | border[1:-1]
        last[:-1] &= ~inside[1:] | border[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, offs)

    def hashes(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each token, and the rows' token offsets."""
        starts, ends, at = self.spans(data, offs)
        return self.of_spans(data, (starts, ends))[0], at

    def of_spans(self, data: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Hashes of the bytes between starts and ends."""
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=sums[1:])
        return [mix64((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _ODD) for starts, ends in spans]


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted by both and distinct: the k-token shingles of each row; a shorter row's tokens are one shingle."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sizes = np.diff(at)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(at[1:], sizes) - np.arange(n)  # tokens from here to the row's end
    acc = np.zeros(n, np.uint64)
    weight = 1
    for j in range(min(k, n)):
        part = h[j:] * np.uint64(weight)
        acc[: n - j] += np.where(left[: n - j] > j, part, np.uint64(0))
        weight = (weight * 0xC2B2AE3D27D4EB4F) % (1 << 64)
    short = np.repeat(sizes < k, sizes)
    first = np.zeros(n, bool)
    first[at[:-1][sizes > 0]] = True
    keep = (left >= k) | (short & first)
    out = mix64(acc + np.minimum(left, k).astype(np.uint64))[keep]
    rows = rows[keep]
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (out[1:] != out[:-1])
    return rows[new], out[new]
