"""Which fixed-size windows of a corpus occur more than once, at the cost of a sample.

A window is `size` consecutive items of one document.  Its anchor is the place
of the least hash among its `gram`-item slices (the rightmost of equal ones).
The anchor depends on the window alone, so equal windows have equal anchors at
the same offset, and two windows can only be equal if their anchor slices are.
Anchors are about 2 / (size - gram + 2) of the items; only they are shuffled.

    anchors     (doc, mark, at, slice, cover): cover is XXH3 of all that the
                windows around the anchor span, `reach` items from their starts
    repeated    anchors whose slice occurs twice or more
    interior    anchors whose cover does, within a slice: every window around
                them is repeated
    open        of each slice with several covers one place per cover; only the
                windows there have to be compared item by item

Ranges are (doc, mark, first, last, depth): windows of `depth` items that start
at first .. last, as far as the document holds them.

Documents are known by (doc_id, hash of the text); rows equal in both have equal
results and count as separate occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import materialise

KEYS = ["doc", "mark"]


class WordItems:
    """A batch's words: rows (offsets), hashes of runs, digests of ranges."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.words = textkit.Words(buf, off)
        self.rows = self.words.row

    @cached_property
    def _joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        return self.words.joined()

    def runs(self, size: int, seed: int = 0) -> np.ndarray:
        return textkit.runs(self.words.hashes(seed=seed), size)

    def digests(self, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
        raw, start, end = self._joined
        return textkit.digests(raw, start[first], end[last - 1], seed) if len(first) else np.zeros(0, np.uint64)


class ByteItems:
    """A batch's bytes, in the same way."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.rows = buf, off

    @cached_property
    def raw(self) -> bytes:
        return self.buf.tobytes()

    def runs(self, size: int, seed: int = 0) -> np.ndarray:
        return textkit.byte_runs(self.buf, size, seed)

    def digests(self, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
        return textkit.digests(self.raw, first, last, seed)


@dataclass(frozen=True)
class Unit:
    """size: items of the least window; gram: of a slice; reach: of the longest window."""

    size: int
    gram: int
    reach: int
    items: Callable[[np.ndarray, np.ndarray], WordItems | ByteItems]


WORDS = Unit(35, 6, 35, WordItems)
BYTES = Unit(256, 64, 400, ByteItems)


class Windows:
    """All windows of a batch with their anchors' places."""

    def __init__(self, unit: Unit, buf: np.ndarray, off: np.ndarray):
        self.unit, self.items = unit, unit.items(buf, off)
        self.rows = self.items.rows
        n = int(self.rows[-1])
        self.start = textkit.windows(self.rows, unit.size) if n else np.zeros(0, np.int64)
        self.grams = self.items.runs(unit.gram)
        self.anchor = textkit.minimisers(self.grams, self.start, unit.size - unit.gram + 1) if len(self.start) else self.start


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, mark, text): null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def anchors(docs: DataFrame, unit: Unit, side: int = 0) -> DataFrame:
    """The anchors of keyed documents, no shuffle.

    With a side, also `left` and `right`: digests of the slice with so many items
    before and behind it, 0 where the document has fewer.
    """
    names = [*KEYS, "at", "slice", "cover", *(("left", "right") if side else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, 1 << 20):
            w = Windows(unit, *textkit.utf8(batch.column("text")))
            at = np.unique(w.anchor)
            row = np.searchsorted(w.rows, at, "right") - 1
            first = np.maximum(w.rows[row], at + unit.gram - unit.size)
            last = np.minimum(w.rows[row + 1], at + unit.reach)
            made = [w.grams[at], textkit.step(w.items.digests(first, last), (at - first).astype(np.uint64))]
            for begin in (at - side, at) if side else ():
                fits = np.flatnonzero((begin >= w.rows[row]) & (begin + side + unit.gram <= w.rows[row + 1]))
                beside = np.zeros(len(at), np.uint64)
                beside[fits] = w.items.digests(begin[fits], begin[fits] + side + unit.gram) | np.uint64(1)
                made.append(beside)
            of = [batch.column(c).take(pa.array(row)) for c in KEYS]
            yield pa.RecordBatch.from_arrays([*of, pa.array((at - w.rows[row]).astype(np.int32)), *[pa.array(x.astype(np.int64)) for x in made]], names)
        textkit.release()

    kinds = "".join(f", {c} bigint" for c in names[3:])
    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, mark bigint, at int{kinds}")


class Sieve:
    """A filter of fixed size (2**bits bits) for hashed keys: what it stops isn't among the keys.

    It is built by a map-side combined aggregate and is the same size for any
    corpus; the exact join that follows decides.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = 25):
        k = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
        words = keys.select(k.alias("k")).selectExpr("shiftright(k, 6) AS i", "shiftleft(1L, cast(k & 63 AS int)) AS b")
        found = words.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[np.asarray(found.column("i").combine_chunks()).astype(np.int64)] = np.asarray(found.column("b").combine_chunks()).astype(np.int64).view(np.uint64)
        self.bits, self.table = bits, keys.sparkSession.sparkContext.broadcast(table)

    def passed(self, df: DataFrame, column: str, inside: bool = True) -> DataFrame:
        table, mask = self.table, (1 << self.bits) - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                k = np.asarray(batch.column(column)).astype(np.int64).astype(np.uint64) & np.uint64(mask)
                hit = (table.value[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63)) & np.uint64(1)).astype(bool)
                rows = np.flatnonzero(hit == inside)
                if len(rows):
                    yield batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))
            textkit.release()

        return df.mapInArrow(run, df.schema)


def candidates(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Anchors whose slice the counts (slice, n) have twice or more, written to the shared folder."""
    repeated = counts.filter("n > 1").select("slice")
    sieved = Sieve(repeated, "slice", 26).passed(found, "slice")
    return materialise(sieved.join(repeated, "slice", "left_semi"), "candidates")


def covers(found: DataFrame, *more: str) -> DataFrame:
    """Of candidates, one row for each cover: its count n, and one of its places (with the columns `more`)."""
    per = found.groupBy("slice", "cover").agg(F.count("*").alias("n"), F.min(F.struct(*KEYS, "at", *more)).alias("place"))
    return materialise(per, "covers")


def around(places: DataFrame, unit: Unit) -> DataFrame:
    """The range of the windows around each place of an anchor."""
    return places.select(*KEYS, F.greatest(F.col("at") + unit.gram - unit.size, F.lit(0)).alias("first"), F.col("at").alias("last"), F.lit(unit.reach).alias("depth"))


def interior(found: DataFrame, per: DataFrame, unit: Unit) -> DataFrame:
    """Ranges around anchors whose cover occurs twice or more."""
    many = per.filter("n > 1").select("slice", "cover")
    return around(found.join(many, ["slice", "cover"], "left_semi"), unit)


def open_places(per: DataFrame, *more: str) -> DataFrame:
    """(doc, mark, at, slice, *more): one place for each cover of slices that have several covers."""
    several = per.groupBy("slice").agg(F.count("*").alias("covers")).filter("covers > 1")
    return per.join(several, "slice").select("place.doc", "place.mark", "place.at", "slice", *[f"place.{c}" for c in more])


def document_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.xxhash64(*KEYS))


def with_lists(docs: DataFrame, rows: DataFrame, name: str, *columns: str) -> tuple[DataFrame, Sieve]:
    """Documents that have rows (of a table), with those as a list (a document's own, so bounded by it); and the sieve of their keys."""
    sieve = Sieve(document_key(rows.select(*KEYS)), "key")
    per = rows.groupBy(*KEYS).agg(F.collect_list(F.struct(*columns)).alias(name)).withColumnsRenamed({k: f"__{k}" for k in KEYS})
    some = sieve.passed(document_key(docs), "key")
    both = some.join(per, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")), "left")
    return both.drop("key", "__doc", "__mark"), sieve


def ranges_of(batch: pa.RecordBatch, name: str, columns: tuple[str, ...], starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The list column's fields as flat arrays; starts (of each row, in items) are added to all of them."""
    lists = batch.column(name)
    flat = lists.flatten()
    shift = np.repeat(starts, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return tuple(np.asarray(flat.field(c)).astype(np.int64) + shift for c in columns) if len(flat) else tuple(np.zeros(0, np.int64) for _ in columns)


def item_ranges(batch: pa.RecordBatch, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The items that the batch's ranges of windows of `depth` or more items cover, as windows of `depth`."""
    first, last = ranges_of(batch, "ranges", ("first", "last"), rows[:-1])
    (deep,) = ranges_of(batch, "ranges", ("depth",), np.zeros(batch.num_rows, np.int64))
    last = np.minimum(last, rows[np.searchsorted(rows, first, "right")] - depth) if len(first) else last
    some = (deep >= depth) & (last >= first)
    return first[some], last[some] + depth


def removed(docs: DataFrame, ranges: DataFrame, clean: Callable, fields: str) -> DataFrame:
    """Documents without the items in their ranges: (doc, *fields).

    ranges is a table.  clean(buf, off, items) returns the fields' arrays; items(rows, depth) gives
    flat item ranges from the rows' first items.  Documents that the sieve stops
    have no ranges and aren't shuffled.
    """
    some, sieve = with_lists(docs, ranges, "ranges", "first", "last", "depth")
    rest = sieve.passed(document_key(docs), "key", inside=False).select("doc", "text").withColumn("ranges", F.lit(None).cast(some.schema["ranges"].dataType))
    kind = f"doc {docs.schema['doc'].dataType.simpleString()}, {fields}"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, 1 << 20):
            made = clean(*textkit.utf8(batch.column("text")), lambda rows, depth, batch=batch: item_ranges(batch, rows, depth))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *made], ["doc", *names])
        textkit.release()

    return some.select("doc", "text", "ranges").mapInArrow(run, kind).union(rest.mapInArrow(run, kind))
