"""Vectorised byte and word kernels over Arrow string columns.

A slice of a batch is viewed as one byte array with document offsets; words,
lines and n-grams become index arrays, and equality becomes 64-bit hashes.
Slices hold about a MB of text (a single longer text is a slice of its own), so
memory follows the longest text, not the batch; what a batch took goes back to
the system after it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes of a lane
CACHE_BYTES, CACHE_SPAN = 64 << 20, 256


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def trim() -> None:
    """Give memory that is free in this process back to the system, where the C library can: idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column with their bytes and offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    del column, raw, off, offsets, data
    trim()


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one little-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand.

    Every lane of eight bytes is mixed with its number in the span, and the
    mixed lanes are summed: unlike a polynomial's, the sums of repetitive
    spans have no common factors.
    """
    lanes, size = _lanes(data), end - start
    total = mix(lanes[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD
    long = np.flatnonzero(size > 8)
    if len(long):
        count = (size[long] - 1) // 8
        first = np.concatenate([[0], np.cumsum(count)])
        number = np.arange(1, first[-1] + 1) - np.repeat(first[:-1], count)
        at = np.repeat(start[long], count) + 8 * number
        left = np.repeat(end[long], count) - at
        mixed = mix((lanes[at] & _FIRST[np.minimum(left, 8)]) + mix(number.astype(np.uint64) * _ODD))
        total[long] += np.add.reduceat(mixed, first[:-1])
    return mix(total)


def run_hash(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of width neighbouring values, mixed pair by pair over doubling runs."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, level, size, at = None, values if not seed else mix(values + np.uint64(seed)), 1, 0
    while True:
        if width // size & 1:
            part = level[at : at + n]
            out = part if out is None else mix(out * _ODD + part)
            at += size
        if 2 * size > width:
            return mix(out + np.uint64((seed + width * int(_ODD)) & 0xFFFFFFFFFFFFFFFF))
        level = mix(level[:-size] * _ODD + level[size:])
        size *= 2


def _equal(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans of a hold the same bytes as those of b, all of size 1 or more."""
    if not len(size):
        return np.zeros(0, bool)
    same = a[ragged(a_start, size)] == b[ragged(b_start, size)]
    return np.logical_and.reduceat(same, np.concatenate([[0], np.cumsum(size)[:-1]]))


class SpanCache:
    """Id lists of byte spans that were made before.

    Spans of up to seven bytes are keys as they are; longer ones are found by
    their hash and compared byte by byte, so a collision costs time only.
    Spans of more than CACHE_SPAN bytes aren't kept.  At CACHE_BYTES the cache
    starts afresh.
    """

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.key, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.ids, self.ids_at = np.zeros(0, np.uint32), np.zeros(1, np.uint32)
        self.raw, self.raw_at = np.zeros(0, np.uint8), np.zeros(1, np.uint32)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.key, self.entry, self.ids, self.ids_at, self.raw, self.raw_at))

    def _add(self, spans: list[bytes], make: Callable[[list[bytes]], list[list[int]]]) -> np.ndarray:
        """The numbers of new entries."""
        first, lists = len(self.ids_at) - 1, make(spans)
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ids = np.concatenate([self.ids, np.fromiter((t for x in lists for t in x), np.uint32, int(n.sum()))])
        self.ids_at = np.concatenate([self.ids_at, (self.ids_at[-1] + np.cumsum(n)).astype(np.uint32)])
        kept = [s if 7 < len(s) <= CACHE_SPAN else b"" for s in spans]
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(kept), np.uint8)])
        self.raw_at = np.concatenate([self.raw_at, (self.raw_at[-1] + np.cumsum(np.fromiter(map(len, kept), np.int64, len(kept)))).astype(np.uint32)])
        return first + np.arange(len(spans))

    def lists(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, make: Callable[[list[bytes]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the spans in turn, and how many each has; make gives the ids of spans not seen before."""
        if self.nbytes() > CACHE_BYTES:
            self.forget()
        size = end - start
        at, raw = np.zeros(len(size), np.int64), data.tobytes()
        bytes_of = lambda rows: [raw[a:b] for a, b in zip(start[rows].tolist(), end[rows].tolist())]
        big = np.flatnonzero(size > CACHE_SPAN)
        if len(big):
            at[big] = self._add(bytes_of(big), make)
        small = np.flatnonzero(size <= CACHE_SPAN)
        s, n = start[small], size[small]
        key = np.where(n > 7, span_hash(data, s, s + n) | np.uint64(1 << 63), (_lanes(data)[s] & _FIRST[np.minimum(n, 7)]) | n.astype(np.uint64) << np.uint64(56))
        keys, first, where = np.unique(key, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.key, keys)
        fresh = np.ones(len(keys), bool)
        if len(self.key):
            fresh = self.key[np.minimum(spot, len(self.key) - 1)] != keys
        if fresh.any():
            added = self._add(bytes_of(small[first[fresh]]), make)
            self.entry = np.insert(self.entry, spot[fresh], added)
            self.key = np.insert(self.key, spot[fresh], keys[fresh])
        own = self.entry[np.searchsorted(self.key, keys)][where].astype(np.int64)
        long = np.flatnonzero(n > 7)
        begin, end_ = (self.raw_at[own[long] + k].astype(np.int64) for k in (0, 1))
        alike = end_ - begin == n[long]
        alike[alike] = _equal(data, s[long[alike]], self.raw, begin[alike], n[long[alike]])
        if not alike.all():
            other = long[~alike]
            own[other] = self._add(bytes_of(small[other]), make)
        at[small] = own
        begin = self.ids_at[at].astype(np.int64)
        count = self.ids_at[at + 1].astype(np.int64) - begin
        return self.ids[ragged(begin, count)], count


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a slice: byte spans, the first word of each document, and each word's document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        space = SPACE[data]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        before[inner] = True
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        after[inner - 1] = True
        self.space = space
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.start, self.end)

    def windows(self, width: int) -> np.ndarray:
        """The word at which each window of width words of one document starts."""
        n = len(self.start) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indexes start[0] .. start[0]+length[0]-1, start[1] .. and so on, as one array."""
    out = np.ones(int(length.sum()), np.int64)
    if not len(out):
        return out
    full = length > 0
    s, n = start[full], length[full]
    ends = np.cumsum(n)
    out[0] = s[0]
    out[ends[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
