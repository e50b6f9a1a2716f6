"""n-grams of many texts at once, as numbers, and lists of places as bytes: numpy helpers for tasks."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np

#: Texts that are worked on at once have so many bytes, unless one text alone has more.
BYTES = 1 << 22
_LETTERS: list[np.ndarray] = []


def slices(lengths: np.ndarray, rows: int, most: int = BYTES) -> Iterator[tuple[int, int]]:
    """(start, end) of consecutive rows: at most so many, with at most ``most`` bytes, or one row alone."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = min(max(to, at + 1), at + rows, len(lengths))
        yield at, to
        at = to


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one text after the other, and which text each belongs to."""
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), owner


def runs(keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ``keys``."""
    return np.flatnonzero(np.concatenate([[len(keys) > 0], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def trigrams(texts: list[str]) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """(start, end, trigrams, starts, places) of parts of ``texts``, mostly of all: the places in a part that hold a trigram, ascending, its list beginning at its start."""
    at, owner = points(texts)
    seen = np.zeros(0x110000, np.int64)
    seen[at] = 1
    alphabet = np.flatnonzero(seen)
    base, n = len(alphabet), len(texts)
    if n > 1 and base**3 * n >= 2**63:
        for a, b in ((0, n // 2), (n // 2, n)):
            for c, d, *found in trigrams(texts[a:b]):
                yield a + c, a + d, *found
        return
    seen[alphabet] = np.arange(base)
    found = np.zeros(0, np.int64)
    for a in range(0, max(len(at) - 2, 0), BYTES):  # one text alone may be long
        rank, own = seen[at[a : a + BYTES + 2]], owner[a : a + BYTES + 2]
        key = ((rank[:-2] * base + rank[1:-1]) * base + rank[2:]) * n + own[:-2]
        key = key[own[:-2] == own[2:]]
        key.sort()
        found = key[runs(key)] if not len(found) else np.union1d(found, key[runs(key)])
    code = found // n
    starts = runs(code)
    code, place = code[starts], found % n
    said = alphabet[np.stack([code // (base * base), code // base % base, code % base], 1)].astype("<u4").tobytes().decode("utf-32-le") if len(code) else ""
    yield 0, n, [said[i : i + 3] for i in range(0, len(said), 3)], starts, place


def pack(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Lists of ascending numbers, each beginning at its start, as bytes: the steps from one to the next; a byte of 255 adds to the one after it."""
    if not len(starts):
        return []
    step = np.diff(values, prepend=-1)
    step[starts] = values[starts] + 1
    more, rest = np.divmod(step, 255)
    ends = np.cumsum(more + 1)
    out = np.full(ends[-1], 255, np.uint8)
    out[ends - 1] = rest
    cuts, data = [0, *ends[np.append(starts[1:], len(values)) - 1].tolist()], out.tobytes()
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def unpack(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(which list, number) of all numbers of packed lists."""
    raw = np.frombuffer(b"".join(lists), np.uint8)
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    which, total = np.repeat(np.arange(len(lists)), lengths), np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])
    before = total[np.cumsum(lengths) - lengths]
    last = raw < 255
    return which[last], (total[1:] - before[which] - 1)[last]


def letters() -> np.ndarray:
    """For each code point, whether words are made of it."""
    if not _LETTERS:
        every = np.zeros(0x110000, bool)
        for m in re.finditer(r"[^\W\d_]+", "".join(map(chr, range(sys.maxunicode + 1)))):
            every[m.start() : m.end()] = True
        _LETTERS.append(every)
    return _LETTERS[0]


def pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, pairs, counts): how often two letters stand side by side in each text, as first * 2^21 + second; words of one letter count with second 0. At most 2^20 texts."""
    at, owner = points(texts)
    letter, at = letters()[at], at.astype(np.int64)
    beside = letter[:-1] & letter[1:] & (owner[:-1] == owner[1:])
    alone = letter & ~np.append(beside, False)[: len(at)] & ~np.append(False, beside)[: len(at)]
    i, j = np.flatnonzero(beside), np.flatnonzero(alone)
    key = np.concatenate([owner[i].astype(np.int64) << 42 | at[i] << 21 | at[i + 1], owner[j].astype(np.int64) << 42 | at[j] << 21])
    key.sort()
    starts = runs(key)
    found = key[starts]
    offsets = np.searchsorted(found, np.arange(len(texts) + 1, dtype=np.int64) << 42)
    return offsets, found & ((1 << 42) - 1), np.diff(np.append(starts, len(key)))
