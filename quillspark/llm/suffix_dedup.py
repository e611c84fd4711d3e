"""Repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Equal windows of 256 bytes have equal anchors (see repeats), so only segments
around anchors whose slice occurs with several surroundings can hold repeats
whose extent is open.  Such a window reaches at least SIDE bytes from the slice
to one of its sides, so a segment is cut in two: the windows that reach so far
to the left meet by the slice and the SIDE bytes before it, the others by the
slice and the SIDE bytes behind it.  A task builds the transform of the segments
of some keys and expands its intervals breadth first: the intervals of common
prefixes of length n, extended backwards by the symbol in front, are those of
length n + 1, and rows that part at that step have a common prefix of exactly n.
A symbol is a block of 16 bytes, so the expansion stops at 25: rows that are
still together start equal windows of 400 bytes, and those together at 16 equal
windows of 256.

Windows of 400 bytes are removed.  Those of 256 bytes are only counted: passages
of fifty words are often shorter than 400 bytes, and `n_repeated` shows them.

A key with over LARGE segments isn't gathered into one task: its windows are
compared by two independent 64-bit hashes in a shuffle of single windows instead.

Edge cases: a null text is empty; a text shorter than a window loses nothing;
rows equal in id and text repeat each other; windows of one document may overlap
each other; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, textkit
from .repeats import BYTES, KEYS
from .storage import kept, materialise, scratch

#: Segments of a key that one task takes (4 MB), and bytes of segments in a transform.
LARGE = 8000
TOGETHER = 256 << 10
#: Bytes beside a slice that are part of a key.
SIDE = (BYTES.size - BYTES.gram) // 2
#: Bytes of the windows that are counted and of those that are removed.
DEPTHS = (BYTES.size, BYTES.reach)


def blocks(text: np.ndarray, stride: int) -> np.ndarray:
    """The symbol at each place: the number of the next `stride` bytes (16, or at most 8) among all, in any fixed order."""
    code = textkit.eights(text)[: len(text)] & textkit.LOW[min(stride, 8)]
    half = np.unique(code, return_inverse=True)[1].astype(np.int64)
    if stride <= 8:
        return half
    pair = half * (len(text) + 1)
    pair[: max(0, len(text) - 8)] += half[8:] + 1
    return np.unique(pair, return_inverse=True)[1].astype(np.int64)


def suffix_order(symbols: np.ndarray, stride: int, depth: int) -> np.ndarray:
    """Places in an order of at least their first `depth` bytes, by prefix tripling (doubling for very long texts)."""
    n, rank, have = len(symbols), symbols, stride
    times = 3 if n < 1 << 20 else 2
    order = np.argsort(rank) if have >= depth else None
    while have < depth:
        key = rank.copy()
        for t in range(1, times):
            key *= n + 1
            key[: max(0, n - t * have)] += rank[t * have :] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        have *= times
        if n and rank[order[-1]] == n - 1:
            break
    return order


def common_prefixes(symbols: np.ndarray, stride: int, order: np.ndarray, stop: int) -> np.ndarray:
    """For each row how many symbols it shares with the row before, at most `stop`, in increasing order.

    The symbol in front of a place stands `stride` bytes before it, so the text
    is transformed as `stride` interleaved strings over blocks of bytes.
    follow[r] is the row of the place one symbol later, so row r is the backward
    extension of row follow[r] by its own symbol.
    """
    n = len(symbols)
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    follow = row[(order + stride) % n]
    first = symbols[order]
    shared = np.full(n, stop, np.int32)
    parted = np.ones(n, bool)
    parted[1:] = first[1:] != first[:-1]
    shared[parted] = 0
    together = np.flatnonzero(~parted)
    above, below = follow[together - 1], follow[together]
    for length in range(1, stop):
        interval = np.cumsum(parted, dtype=np.int32)  # the intervals of common prefixes of this length
        same = interval[above] == interval[below]
        ended = together[~same]
        if not len(ended):  # no interval has changed, so none will
            break
        shared[ended] = length
        parted[ended] = True
        together, above, below = together[same], above[same], below[same]
    return shared


def equal_windows(segments: list[bytes], windows: np.ndarray, depths: tuple[int, ...]) -> list[np.ndarray]:
    """For each depth, which of the segments' first windows[i] places begin a string of so many bytes that such a place elsewhere begins too.

    One array for all segments, with a place behind each segment's that is never
    hit.  Only strings that their segment holds whole are compared, so what
    stands behind a segment never decides.
    """
    stride = next(x for x in (16, 8, 5, 4, 3, 2, 1) if all(d % x == 0 for d in depths))
    sizes = np.array([len(s) for s in segments])
    at = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(segments), np.uint8)
    symbols = blocks(text, stride)
    order = suffix_order(symbols, stride, max(depths))
    shared = common_prefixes(symbols, stride, order, max(depths) // stride)
    base = np.cumsum(windows + 1) - windows - 1
    place = np.arange(int(windows.sum()) + len(windows)) + np.repeat(at - base, windows + 1)
    place[base + windows] = 0
    found = []
    for depth in depths:
        group = np.cumsum(shared < depth // stride)
        wanted = textkit.covered(at, at + np.clip(sizes - depth + 1, 0, windows), len(text))[order]
        count = np.bincount(group[wanted], minlength=int(group[-1]) + 1)
        hit = np.zeros(len(text), bool)
        hit[order[wanted & (count[group] > 1)]] = True
        flat = hit[place]
        flat[base + windows] = False
        found.append(flat)
    return found


class Sides:
    """The windows around a batch's listed anchors that reach to the listed side."""

    def __init__(self, batch: pa.RecordBatch, unit: repeats.Unit, side: int):
        self.batch, self.unit, self.w = batch, unit, repeats.Windows(unit, *textkit.utf8(batch.column("text")))
        (place,) = repeats.ranges_of(batch, "places", ("at",), self.w.rows[:-1])
        right, key = repeats.ranges_of(batch, "places", ("right", "key"), np.zeros(batch.num_rows, np.int64))
        a, b = np.searchsorted(self.w.anchor, place, "left"), np.searchsorted(self.w.anchor, place, "right")
        some = b > a
        place, right = place[some], right[some] == 1
        first, last = self.w.start[a[some]], self.w.start[b[some] - 1]
        first, last = np.where(right, np.maximum(first, place - side + 1), first), np.where(right, last, np.minimum(last, place - side))
        held = last >= first
        self.first, self.last, self.key = first[held], last[held], key[some][held]
        self.row = np.searchsorted(self.w.rows, self.first, "right") - 1
        self.end = np.minimum(self.last + unit.reach, self.w.rows[self.row + 1])

    def columns(self, row: np.ndarray, at: np.ndarray) -> list[pa.Array]:
        return [self.batch.column("doc").take(pa.array(row)), self.batch.column("mark").take(pa.array(row)), pa.array((at - self.w.rows[row]).astype(np.int32))]


def segments(places: DataFrame, unit: repeats.Unit, side: int) -> DataFrame:
    """(doc, mark, at, key, windows, segment) of each listed side of an anchor, `at` the first window's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, 1 << 20):
            s = Sides(batch, unit, side)
            raw = s.w.items.raw
            cut = pa.array([raw[x:y] for x, y in zip(s.first.tolist(), s.end.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*s.columns(s.row, s.first), pa.array(s.key), pa.array((s.last - s.first + 1).astype(np.int32)), cut], [*KEYS, "at", "key", "windows", "segment"])
        textkit.release()

    return places.mapInArrow(run, f"doc {places.schema['doc'].dataType.simpleString()}, mark bigint, at int, key bigint, windows int, segment binary")


def window_hashes(places: DataFrame, unit: repeats.Unit, side: int, depths: tuple[int, ...]) -> DataFrame:
    """(doc, mark, at, depth, first, second): two independent hashes of each window of a listed side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, 1 << 20):
            s = Sides(batch, unit, side)
            count = s.last - s.first + 1
            start = np.repeat(s.first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            row = np.repeat(s.row, count)
            for depth in depths:
                fits = start + depth <= s.w.rows[row + 1]
                hashes = [s.w.items.runs(depth, seed)[start[fits]] for seed in (1, 2)]
                at = s.columns(row[fits], start[fits])
                yield pa.RecordBatch.from_arrays([*at, pa.array(np.full(len(at[2]), depth, np.int32)), *[pa.array(h.astype(np.int64)) for h in hashes]], [*KEYS, "at", "depth", "first", "second"])
        textkit.release()

    return places.mapInArrow(run, f"doc {places.schema['doc'].dataType.simpleString()}, mark bigint, at int, depth int, first bigint, second bigint")


def expanded(parts: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """Ranges of the segments' windows that are repeated; whole keys meet in a task."""
    dealt = parts.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight = 0
        for batch in batches:
            for one in textkit.pieces(iter([batch]), TOGETHER, "segment"):
                held.append(one)
                weight += one.nbytes
                if weight > TOGETHER:
                    rows = pa.concat_batches(held)
                    key = np.asarray(rows.column("key"))
                    whole = int(np.searchsorted(key, key[-1]))  # rows of keys that have ended
                    if whole:
                        yield from found(rows.slice(0, whole))
                    held = [rows.slice(whole)]
                    weight = held[0].nbytes if whole else 0
        if held:
            yield from found(pa.concat_batches(held))
        held = []
        textkit.release()

    def found(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = np.asarray(rows.column("key"))
        same = key[1:] == key[:-1]
        rows = rows.take(pa.array(np.flatnonzero(np.append(same, False) | np.append(False, same))))  # one segment of a key meets no other
        if not rows.num_rows:
            return
        windows = np.asarray(rows.column("windows")).astype(np.int64)
        at = np.asarray(rows.column("at")).astype(np.int64)
        base = np.cumsum(windows + 1) - windows - 1
        # equal segments are one in the transform, and all their windows are repeated
        names: dict[tuple[bytes, int], int] = {}
        segments = rows.column("segment").to_pylist()
        which = np.array([names.setdefault(x, len(names)) for x in zip(segments, windows.tolist(), strict=True)])
        twice = np.bincount(which)[which] > 1
        sizes = np.array([len(x) for x in segments])
        own = np.array([n for _, n in names], np.int64)
        first = (np.cumsum(own + 1) - own - 1)[which]
        place = np.repeat(first - base, windows + 1) + np.arange(int(base[-1] + windows[-1] + 1))
        for depth, distinct in zip(depths, equal_windows([x for x, _ in names], own, depths), strict=True):
            whole = base[twice]
            hit = distinct[place] | textkit.covered(whole, whole + np.clip(sizes - depth + 1, 0, windows)[twice], len(place))
            step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1
            who = np.searchsorted(base, first, "right") - 1
            if len(first):
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc").take(pa.array(who)),
                        rows.column("mark").take(pa.array(who)),
                        pa.array((at[who] + first - base[who]).astype(np.int32)),
                        pa.array((at[who] + last - base[who]).astype(np.int32)),
                        pa.array(np.full(len(who), depth, np.int32)),
                    ],
                    [*KEYS, "first", "last", "depth"],
                )

    return dealt.mapInArrow(run, f"doc {parts.schema['doc'].dataType.simpleString()}, mark bigint, first int, last int, depth int")


def sides(places: DataFrame) -> DataFrame:
    """(doc, mark, at, right, key, n): each side of an open place whose key n > 1 places have."""
    both = F.array(*[F.struct(F.lit(i).alias("right"), F.col(c).alias("side")) for i, c in enumerate(("left", "right"))])
    each = places.select(*KEYS, "at", "slice", F.explode(both).alias("s")).filter("s.side <> 0")
    keyed = materialise(each.select(*KEYS, "at", "s.right", F.xxhash64("slice", "s.side", "s.right").alias("key")), "sides")
    counts = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "side-counts")
    return keyed.join(counts, "key")


def repeated_ranges(docs: DataFrame, found: DataFrame, unit: repeats.Unit = BYTES, side: int = SIDE, depths: tuple[int, ...] = DEPTHS, large: int = LARGE) -> DataFrame:
    """Ranges of the keyed documents' repeated windows of each depth."""
    counts = materialise(found.groupBy("slice").agg(F.count("*").alias("n")).filter("n > 1"), "slices")  # a plain table on one side lets Spark split a hot slice on the other
    hits = repeats.candidates(found, counts)
    per = repeats.covers(hits, "left", "right")
    places = materialise(sides(repeats.open_places(per, "left", "right")), "open")
    few, _ = repeats.with_lists(docs, places.filter(F.col("n") <= large), "places", "at", "right", "key")
    ranges = repeats.interior(hits, per, unit).union(expanded(segments(few, unit, side), depths))
    many, _ = repeats.with_lists(docs, places.filter(F.col("n") > large), "places", "at", "right", "key")
    windows = materialise(window_hashes(many, unit, side, depths), "windows")
    again = windows.groupBy("first", "second", "depth").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    verified = windows.join(again, ["first", "second", "depth"], "left_semi")
    return ranges.union(verified.select(*KEYS, F.col("at").alias("first"), F.col("at").alias("last"), "depth"))


def clean(buf: np.ndarray, off: np.ndarray, items) -> list:
    gone, again = (textkit.covered(*items(off, depth), len(buf)) if len(buf) else np.zeros(0, bool) for depth in reversed(DEPTHS))
    begins = gone & ~np.append(False, gone[:-1])
    begins[off[:-1][np.diff(off) > 0]] |= gone[off[:-1][np.diff(off) > 0]]
    raw = buf[~gone].tobytes()
    cut = np.append(0, np.cumsum(~gone))[off].tolist()
    kept = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    text = pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
    counts = [pa.array(textkit.segment_sums(x, off)) for x in (gone, begins, again)]
    return [pa.array(np.diff(off).astype(np.int64)), *counts, text, pa.array(kept)]


FIELDS = "n_bytes bigint, n_removed bigint, n_spans bigint, n_repeated bigint, kept binary, kept_sha256 string"


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, n_repeated, kept, kept_sha256): kept is the remaining bytes.

    n_repeated: bytes covered by 256-byte strings that also start anywhere else.
    """
    base = repeats.keyed(docs)
    with scratch(docs.sparkSession):
        ranges = kept(repeated_ranges(base, materialise(repeats.anchors(base, BYTES, SIDE), "anchors")), "ranges")
    return repeats.removed(base, ranges, clean, FIELDS)


def digest(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs).select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated")
