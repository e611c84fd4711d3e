"""Document fingerprints: bottom-k sketches of hashed word shingles.

A sketch holds the k least distinct hashes of a text's shingles, in ascending
order.  Sketches of parts merge into the sketch of the whole (union, keep the k
least), and two sketches estimate resemblance, containment and the number of
distinct shingles.  Fewer than k hashes are the exact set.

Edge cases: null is the empty text, whose sketch is empty; fewer words than a
shingle make one shingle of them all; two empty sketches have likeness 1, an
empty and another 0; rows with equal ids are ordered by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .attach import attach

K = 256
SHINGLE = 5
#: Of a shingle's hash; the other bits number the rows of a batch.
HASH_BITS = 48


def sketches(buf: np.ndarray, off: np.ndarray, k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """One ascending uint64 array of at most k hashes for each row; at most 65,536 rows."""
    rows = len(off) - 1
    row, found = textkit.shingles(textkit.Words(buf, off), size, lower=True)
    # row and hash in one word sort many times faster than two keys
    keys = np.sort(row.astype(np.uint64) << np.uint64(HASH_BITS) | found >> np.uint64(64 - HASH_BITS))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    at = np.searchsorted(keys, np.arange(rows + 1, dtype=np.uint64) << np.uint64(HASH_BITS))
    h = keys & np.uint64((1 << HASH_BITS) - 1)
    return [h[a : min(b, a + k)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: of the k least of the union, the share that both hold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)[:k]
    return float(np.count_nonzero(both <= union[-1]) / len(union))


def distinct_estimate(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact for fewer than k hashes."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**HASH_BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    na, nb = distinct_estimate(a, k), distinct_estimate(b, k)
    return float(min(1.0, j * (na + nb) / (1 + j) / na))


def fingerprint(docs: DataFrame, name: str = "sketch", text: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """docs with a struct column: `hashes` array<bigint>, and the estimate `n_distinct`."""

    def make(buf, off):
        found = sketches(buf, off, k, size)
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.uint64), *found]).astype(np.int64)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), np.array([distinct_estimate(x, k) for x in found], float)]

    return attach(docs, name, "struct<hashes:array<bigint>,n_distinct:double>", make, text)


def merge(parts: DataFrame, by: list[str], hashes: str = "hashes", k: int = K) -> DataFrame:
    """Sketches of the unions: of each group's distinct hashes, the k least (limited before the shuffle)."""
    each = parts.select(*by, F.explode(hashes).alias("__h"))
    least = each.withColumn("__r", F.dense_rank().over(Window.partitionBy(*by).orderBy("__h"))).filter(F.col("__r") <= k)
    merged = least.groupBy(*by).agg(F.array_sort(F.collect_set("__h")).alias(hashes))
    return merged


def hexed(hashes: Column) -> Column:
    """A sketch as text: 12 lowercase hexadecimal digits for each hash."""
    return F.array_join(F.transform(hashes, lambda x: F.lpad(F.lower(F.hex(x)), HASH_BITS // 4, "0")), "")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text, part, extra): each part is a range of ids, and ends with the next range's first row as an extra.

    The range limits are ids of the table, so the first row of each range is
    known from its id; each is sent to the range before it as well, and the very
    first row (known by id and a hash of its text) to the last range.
    """
    ids = docs.select("doc_id")
    limits = sorted({int(x) for x in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    cuts = np.array(limits, np.int64)
    none = np.iinfo(np.int64).min
    least = docs.agg(F.min(F.struct(F.coalesce("doc_id", F.lit(none)).alias("id"), F.col("text"), F.xxhash64("text").alias("mark"))).alias("r")).select("r.id", "r.mark").first()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = np.asarray(batch.column("doc_id").fill_null(none))
            part = np.searchsorted(cuts, doc_id, "right").astype(np.int32)
            first = np.flatnonzero((doc_id == least["id"]) & (np.asarray(batch.column("mark")) == least["mark"]))
            last = np.full(len(part), len(cuts), np.int32)
            every = batch.drop_columns(["mark"])
            for p, extra, rows in ((part, False, np.arange(len(part))), (part - 1, True, np.flatnonzero(np.isin(doc_id, cuts))), (last, True, first)):
                if len(rows):
                    out = every.take(pa.array(rows)) if extra else every
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(p[rows].astype(np.int32)), pa.array(np.full(len(rows), extra))], ["doc_id", "text", "part", "extra"])
        textkit.release()

    placed = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    return placed.mapInArrow(place, "doc_id bigint, text string, part int, extra boolean")


def edited_likeness(docs: DataFrame, k: int = K, size: int = SHINGLE, parts: int | None = None) -> DataFrame:
    """Sketches of each text and of its edited text, and their likenesses.

    The edited text has its last half replaced by as much of the next document's
    beginning (ascending id; after the last, the first).  One shuffle, by ranges
    of ids; a task streams its sorted ranges and holds a slice of them.
    """
    spark = docs.sparkSession
    n = parts or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    laid = with_next(base, n).repartition(n, "part").sortWithinPartitions("part", "extra", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the rows since the last one done; the first waits for its next
        for batch in textkit.pieces(batches, 1 << 20):
            held += list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "extra")), strict=True))
            yield from done(held, False)
            held = held[-1:]
        if held:
            yield from done(held, True)
        held = []
        textkit.release()

    def done(rows: list[tuple], over: bool) -> Iterator[pa.RecordBatch]:
        todo = []
        for i, (doc_id, text, part, extra) in enumerate(rows):
            if i + 1 == len(rows) and not over or extra:
                continue
            after = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][2] == part else ""
            half = len(text) // 2
            todo.append((doc_id, text, after, text[: len(text) - half] + after[:half]))
        if not todo:
            return
        # each text is sketched once: a next text is most often the following row's own
        texts = [x[1] for x in todo]
        places, known = [], {id(t): i for i, t in enumerate(texts)}
        for x in todo:
            if id(x[2]) not in known:
                known[id(x[2])] = len(texts)
                texts.append(x[2])
            places.append(known[id(x[2])])
        found = sketches(*textkit.utf8(pa.array(texts + [x[3] for x in todo], pa.large_string())), k, size)
        ours, nexts, edited = found[: len(todo)], [found[i] for i in places], found[len(texts) :]
        lists = lambda many: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in many])]).astype(np.int32), np.concatenate([np.zeros(0, np.uint64), *many]).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in todo], pa.int64()),
                pa.array([len(x[1]) for x in todo], pa.int64()),
                pa.array([x[3] for x in todo], pa.string()),
                lists(ours),
                lists(edited),
                pa.array([resemblance(a, b, k) for a, b in zip(ours, edited, strict=True)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(ours, nexts, strict=True)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited", "hashes", "edited_hashes", "near_edited", "near_next"],
        )

    return laid.mapInArrow(run, "doc_id bigint, n_chars bigint, edited string, hashes array<bigint>, edited_hashes array<bigint>, near_edited double, near_next double")


def digest(docs: DataFrame) -> DataFrame:
    return edited_likeness(docs).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        hexed(F.col("hashes")).alias("fingerprint"),
        hexed(F.col("edited_hashes")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
