"""Substring dedup over a log-structured index of window fingerprints.

The index is a log of immutable runs, each a Parquet table of (slice, cover, n,
place) sorted by fingerprint: one run for each batch of documents.  A batch is
joined with the earlier runs; what meets history is verified on whole windows by
two independent 64-bit hashes, read at the places in the earlier documents, and
repeats are given for both sides.  Compaction merges the runs into one.  Runs
hold the anchors' fingerprints (see repeats): every window has one, so none is
missed.

Edge cases: a null text has no words; a text shorter than the window has none to
remove; rows equal in id and text repeat each other; self-overlapping repeats
count; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats, textkit
from .repeats import KEYS, WORDS, Unit
from .storage import delete, kept, materialise, new_folder, scratch

#: Batches in which the query adds the documents to its index.
BATCHES = 2
#: Runs that a batch is joined with; as many are compacted into one first.
FAN_IN = 4


class FingerprintIndex:
    """Runs of fingerprints in the shared folder, and the keyed documents that their places point to."""

    def __init__(self, spark: SparkSession, runs: list[str] | None = None, docs: DataFrame | None = None):
        self.spark, self.runs, self.docs = spark, list(runs or []), docs

    def append(self, found: DataFrame) -> str:
        """Writes the anchors' fingerprints as a new sorted run."""
        self.runs.append(self._write(_merged(found.select("slice", "cover", F.lit(1).cast("bigint").alias("n"), F.struct("doc", "mark", "at").alias("place")))))
        return self.runs[-1]

    def _write(self, entries: DataFrame) -> str:
        path = new_folder(self.spark, "run")
        entries.sortWithinPartitions("slice", "cover").write.option("compression", "zstd").parquet(path)
        return path

    def entries(self) -> DataFrame:
        """(slice, cover, n, place) of all runs; a fingerprint of several runs has as many rows."""
        rows = None
        for path in self.runs:
            run = self.spark.read.parquet(path)
            rows = run if rows is None else rows.union(run)
        return rows

    def counts(self) -> DataFrame:
        """(slice, n) over all runs."""
        return self.entries().groupBy("slice").agg(F.sum("n").alias("n"))

    def compact(self) -> str:
        """Replaces all runs by one; the old tables stay for readers that began before."""
        self.runs = [self._write(_merged(self.entries()))]
        return self.runs[0]

    def drop(self) -> None:
        """Deletes the runs."""
        delete(self.spark, *self.runs)
        self.runs = []

    def add(self, docs: DataFrame, found: DataFrame, unit: Unit = WORDS) -> DataFrame:
        """Verifies a batch (keyed documents and their anchors) against itself and all runs, then appends it.

        Ranges of the windows that are repeated as of this batch, in the batch and
        in earlier ones.  An earlier
        range that was given before may be missing: the union over the batches is
        that of all documents at once.
        """
        if len(self.runs) >= FAN_IN:
            self.compact()
        history, earlier = list(self.runs), self.docs
        path = self.append(found)
        self.docs = docs if earlier is None else earlier.union(docs)
        both = self.spark.read.parquet(path).withColumn("old", F.lit(False))
        if history:
            past = FingerprintIndex(self.spark, history).entries()
            new = both.select("slice")
            past = repeats.Sieve(new, "slice", 26).passed(past, "slice").join(new.distinct(), "slice", "left_semi")
            both = both.union(past.withColumn("old", F.lit(True)))
        return repeated_ranges(self.docs, found, both, unit)


def _merged(entries: DataFrame) -> DataFrame:
    return entries.groupBy("slice", "cover").agg(F.sum("n").alias("n"), F.min("place").alias("place"))


def window_hashes(docs: DataFrame, unit: Unit = WORDS) -> DataFrame:
    """(doc, mark, at, first, second) of the windows whose anchor is among a document's `places`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, 1 << 20):
            w = repeats.Windows(unit, *textkit.utf8(batch.column("text")))
            (wanted,) = repeats.ranges_of(batch, "places", ("at",), w.rows[:-1])
            chosen = np.zeros(int(w.rows[-1]) + 1, bool)
            chosen[wanted] = True
            start = w.start[chosen[w.anchor]] if len(w.start) else w.start
            row = np.searchsorted(w.rows, start, "right") - 1
            first, second = (w.items.runs(unit.size, seed)[start] if len(start) else np.zeros(0, np.uint64) for seed in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(pa.array(row)),
                    batch.column("mark").take(pa.array(row)),
                    pa.array((start - w.rows[row]).astype(np.int32)),
                    pa.array(first.astype(np.int64)),
                    pa.array(second.astype(np.int64)),
                ],
                [*KEYS, "at", "first", "second"],
            )
        textkit.release()

    return docs.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, mark bigint, at int, first bigint, second bigint")


def repeated_ranges(docs: DataFrame, found: DataFrame, entries: DataFrame, unit: Unit = WORDS) -> DataFrame:
    """Ranges of repeated windows.

    docs: the batch and the earlier ones; found: the batch's anchors; entries:
    its fingerprints and those of the earlier runs that share a slice (`old`).
    One place of an old fingerprint is enough: where it has several, all of them
    were repeats before.
    """
    repeated = entries.groupBy("slice").agg(F.sum("n").alias("n")).filter("n > 1").select("slice")
    hits = materialise(repeats.Sieve(repeated, "slice", 26).passed(entries, "slice").join(repeated, "slice", "left_semi"), "candidates")
    least = F.min(F.struct("old", "place"))
    per = materialise(hits.groupBy("slice", "cover").agg(F.sum("n").alias("n"), least["place"].alias("place")), "covers")
    many = per.filter("n > 1").select("cover")
    some = repeats.Sieve(many, "cover", 26).passed(found, "cover")
    once = hits.filter("old and n = 1").select("place.doc", "place.mark", "place.at", "slice", "cover")
    places, _ = repeats.with_lists(docs, materialise(repeats.open_places(per).select(*KEYS, "at"), "open"), "places", "at")
    windows = materialise(window_hashes(places, unit), "windows")
    again = windows.groupBy("first", "second").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    verified = windows.join(again, ["first", "second"], "left_semi")
    inside = repeats.interior(some.select(once.columns).union(once), per, unit)
    return inside.union(verified.select(*KEYS, F.col("at").alias("first"), F.col("at").alias("last"), F.lit(unit.size).alias("depth")))


def clean(buf: np.ndarray, off: np.ndarray, items) -> list:
    words = textkit.Words(buf, off)
    gone = textkit.covered(*items(words.row, WORDS.reach), len(words)) if len(words) else np.zeros(0, bool)
    raw, starts, ends, keep = buf.tobytes(), words.start.tolist(), words.end.tolist(), (~gone).tolist()
    kept = [b" ".join([raw[starts[i] : ends[i]] for i in range(a, b) if keep[i]]) for a, b in zip(words.row[:-1].tolist(), words.row[1:].tolist(), strict=True)]
    return [pa.array(words.counts().astype(np.int64)), pa.array(textkit.segment_sums(gone, words.row)), pa.array(kept, pa.binary())]


def drop_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc, n_words, n_removed, kept): kept is the remaining words joined by one space, as UTF-8 bytes."""
    spark, base, ranges = docs.sparkSession, repeats.keyed(docs), None
    with scratch(spark):
        index = FingerprintIndex(spark)
        for b in range(batches):
            mine = base.filter(F.pmod("mark", F.lit(batches)) == b)
            with scratch(spark):
                now = index.add(mine, materialise(repeats.anchors(mine, WORDS), "anchors"))
                now = kept(now, "batch-ranges")
            ranges = now if ranges is None else ranges.union(now)
        ranges = kept(ranges, "ranges")
        index.drop()
    return repeats.removed(base, ranges, clean, "n_words bigint, n_removed bigint, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs).select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
