"""Vectorised text primitives for Arrow batches: words, hashes of slices and runs, minimisers.

A batch's texts stay one contiguous UTF-8 buffer plus offsets, so that words and
windows of thousands of documents are found by a few numpy passes.  Null texts
are empty texts everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# The six ASCII white space bytes that separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


# Odd multipliers of the mixing steps.
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95), _U(0xA24BAED4963EE407)
LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)
#: Slices of more bytes are hashed one by one.
_LONG = 64
#: Places that are hashed at a time.
_TOGETHER = 1 << 14


def step(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mixes x into h; a multiplication on each side of a shift, so that no pattern of the values cancels."""
    h = h ^ x
    h *= _K1
    h ^= h >> _U(32)
    h *= _K2
    h ^= h >> _U(29)
    return h


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number; zeros follow the end."""
    padded = np.append(buf, np.zeros(8, np.uint8))
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte slices; slices of equal length up to 8 bytes never collide."""
    size = end - start
    h = mix(size.astype(_U) + _U(seed << 48))
    loads, live = eights(buf), np.flatnonzero((size > 0) & (size <= _LONG))
    at = 0
    while len(live):
        left = size[live] - at
        h[live] = step(h[live], loads[start[live] + at] & LOW[np.minimum(left, 8)])
        at += 8
        live = live[left > 8]
    long = np.flatnonzero(size > _LONG)
    if len(long):
        h[long] = digests(buf.tobytes(), start[long], end[long], seed)
    return h


def equal_slices(buf: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a are the m bytes from b, for each pair of slices."""
    same, loads, at = n == m, eights(buf), 0
    live = np.flatnonzero(same & (a != b))
    while len(live):
        left = n[live] - at
        mask = LOW[np.minimum(left, 8)]
        equal = loads[a[live] + at] & mask == loads[b[live] + at] & mask
        same[live[~equal]] = False
        at += 8
        live = live[equal & (left > 8)]
    return same


def digests(raw: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH3 of byte slices."""
    whole, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    return np.array([digest(whole[a:b], seed) for a, b in zip(start.tolist(), end.tolist(), strict=True)], _U)


def _doubled(level: np.ndarray, span: int, size: int, places: int) -> np.ndarray:
    """Hashes of the runs of `size` items at the first places; level[i] stands for `span` items from i on, and span divides size."""
    whole, done, left = None, 0, size // span
    while True:
        if left & 1:
            part = level[done : done + places]
            whole = part if whole is None else step(whole * _K3, part)
            done += span
        left >>= 1
        if not left:
            return whole
        level = step(level[:-span] * _K3, level[span:])
        span *= 2


def runs(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive hashes, by doubling."""
    places = len(values) - size + 1
    return _doubled(values, 1, size, places) if places > 0 else np.zeros(0, _U)


def byte_runs(buf: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of `size` bytes, a multiple of 8, by doubling."""
    places, loads = len(buf) - size + 1, eights(buf)
    parts = []
    for at in range(0, max(0, places), _TOGETHER):  # parts that stay in the processor's cache
        n = min(_TOGETHER, places - at)
        parts.append(_doubled(mix(loads[at : at + n + size - 8] ^ _U(seed << 32)), 8, size, n))
    return np.concatenate([np.zeros(0, _U), *parts])


def release() -> None:
    """Gives memory that a finished task no longer needs back to the system; its worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20, column: str = "text", rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each holds about `limit` bytes of text and at most `rows` rows, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = utf8(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a batch: byte ranges, and for each row the range of its words; space: which bytes stand between words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, space: np.ndarray = IS_SPACE):
        self.buf, self.off, self.space = buf, off, space
        n = len(buf)
        word = ~space[buf]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.zeros(n + 1, bool)
        before[1:] = word
        here = np.zeros(n + 1, bool)
        here[:n] = word
        self.start = np.flatnonzero(here & (~before | edge))
        self.end = np.flatnonzero(before & (~here | edge))
        self.row = np.searchsorted(self.start, off)  # row i has the words row[i] to row[i + 1]

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        return slices(LOWER[self.buf] if lower else self.buf, self.start, self.end, seed)

    def joined(self, lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each begins and ends there."""
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        start = end - size
        spaced = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
        inside = self.buf[~self.space[self.buf]]
        spaced[np.arange(len(inside)) + np.repeat(np.arange(len(size)), size)] = LOWER[inside] if lower else inside
        return spaced.tobytes(), start, end


def windows(rows: np.ndarray, size: int) -> np.ndarray:
    """Starts of all windows of `size` items that lie within one row; rows: offsets of the rows."""
    n = int(rows[-1])
    ok = np.ones(n, bool)
    last = rows[1:]
    # of each row, the final size - 1 items start no window
    lead = np.maximum(rows[:-1], last - size + 1)
    cut = np.zeros(n + 1, np.int64)
    np.add.at(cut, lead, 1)
    np.add.at(cut, last, -1)
    ok[np.cumsum(cut)[:n] > 0] = False
    return np.flatnonzero(ok)


def shingles(words: Words, size: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The row and the hash of every run of `size` words; a row with fewer words, but any, has one of all its words."""
    n = words.counts()
    starts = windows(words.row, size) if len(words) else np.zeros(0, np.int64)
    whole = runs(words.hashes(lower), size)[starts] if len(starts) else np.zeros(0, _U)
    short = np.flatnonzero((n > 0) & (n < size))
    some = LOWER[words.buf] if lower else words.buf
    less = [b" ".join([some[a:b].tobytes() for a, b in zip(words.start[i:j].tolist(), words.end[i:j].tolist(), strict=True)]) for i, j in zip(words.row[short], words.row[short + 1], strict=True)]
    made = np.array([xxhash.xxh3_64_intdigest(x) for x in less], _U)
    return np.concatenate([np.searchsorted(words.row, starts, "right") - 1, short]), np.concatenate([whole, made])


_PLACE = 26  # low bits of a packed minimum that hold the place, rightmost smallest
_PLACES = _U((1 << _PLACE) - 1)


def minimisers(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each window (the grams at start .. start + width - 1), the place of its rightmost least hash.

    Which place is taken depends on the window's own grams only, so equal windows
    take the same place wherever they stand.
    """
    n = len(grams)
    place = _PLACES - (np.arange(n, dtype=_U) & _PLACES)
    packed = (grams & ~_PLACES) | place
    low, span = packed, 1
    while span * 2 <= width:
        nxt = low.copy()
        np.minimum(low[: n - span], low[span:], out=nxt[: n - span])
        low, span = nxt, span * 2
    least = np.minimum(low[starts], low[starts + (width - span)])
    at = (_PLACES - (least & _PLACES)).astype(np.int64)
    return at + (starts & ~np.int64(int(_PLACES))) + np.where(at < (starts & np.int64(int(_PLACES))), np.int64(1 << _PLACE), 0)


def segment_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the items of each row; rows: offsets."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step)[:n] > 0
