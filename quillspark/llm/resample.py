"""Resampling documents towards a target distribution by importance weights over hashed n-grams.

Features are the runs of 1 to `order` words, hashed by CRC-32 into buckets.  The
raw corpus' counts and the target's give each bucket a gain, the logarithm of how
much likelier the target is; a document's weight is the sum over its features,
and Gumbel noise on the weights makes the highest scores a sample without
replacement.

The corpus is counted over deduplicated segments: newlines separate words, so a
text is cut into lines; equal lines meet in one row, their features are counted
once and multiplied by the number of occurrences.  The n-grams that reach over a
newline are added from the documents (there are none at order 1).

Ranks come from one sort by ranges: a row's rank is its place in its partition
behind the sizes of the partitions before.

Edge cases: a null text has no words and no features, as an empty one; texts of
any length are taken whole, with a task's memory bound by its longest row; rows
equal in id and text are documents of their own with one score each and ranks one
after the other; a null id is hashed as the empty string and comes last among
ties; empty documents give an empty table, an empty target counts nothing; extra
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import materialise

ORDER, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Gains and noise are counted in thousandths.
UNIT = 1000
TOGETHER = 2 << 20

NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False


def _steps() -> np.ndarray:
    """What each byte does to a CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)  # fixed value: the reflected polynomial
    return table


STEPS = _steps()


def fed(crc: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Running CRC-32s (not yet inverted at the end), each after one slice of bytes."""
    crc, at, live = crc.copy(), start.copy(), np.flatnonzero(end > start)
    while len(live):
        c = crc[live]
        crc[live] = STEPS[(c ^ buf[at[live]]) & 255] ^ c >> 8
        at[live] += 1
        live = live[at[live] < end[live]]
    return crc


class Features:
    """Buckets of a batch's n-grams, order by order."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, buckets: int):
        self.low = textkit.LOWER[buf]
        self.words, self.buckets = textkit.Words(self.low, off, NOT_WORD), buckets

    def by_order(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each n: n, the first words of the runs of n words in one row, and their buckets."""
        start, end = self.words.start, self.words.end
        crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
        first = np.arange(len(start))
        for n in range(1, order + 1):
            if n > 1:
                first = textkit.windows(self.words.row, n) if len(start) else first
                crc = STEPS[(crc[first] ^ 0x20) & 255] ^ crc[first] >> 8
            run = fed(crc, self.low, start[first + n - 1], end[first + n - 1])
            yield n, first, (run ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % self.buckets
            crc = np.zeros(len(start), np.uint32)
            crc[first] = run

    def row_of(self, first: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.row, first, "right") - 1


def _counted(buckets: int, make: Callable[[pa.RecordBatch], np.ndarray]) -> Callable:
    """A task's pass: adds up the counts that `make` gets from each batch, and gives those that aren't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in textkit.pieces(batches, TOGETHER):
            total += make(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
        textkit.release()

    return run


def segment_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; lines that occur again are counted once and multiplied."""

    def of_lines(batch: pa.RecordBatch) -> np.ndarray:
        found, times, total = Features(*textkit.utf8(batch.column("text")), buckets), batch.column("times").to_numpy(), np.zeros(buckets, np.int64)
        for _, first, bucket in found.by_order(order):
            total += np.bincount(bucket, times[found.row_of(first)], buckets).astype(np.int64)
        return total

    def over_newlines(batch: pa.RecordBatch) -> np.ndarray:
        buf, off = textkit.utf8(batch.column("text"))
        found, total = Features(buf, off, buckets), np.zeros(buckets, np.int64)
        line = np.cumsum(buf == 0x0A)[found.words.start] if len(buf) else found.words.start
        for n, first, bucket in found.by_order(order):
            total += np.bincount(bucket[line[first] < line[first + n - 1]], minlength=buckets)
        return total

    kind = "bucket bigint, n bigint"
    whole = docs.select(F.col(text).alias("text"))
    lines = whole.select(F.explode(F.split("text", "\n")).alias("text")).groupBy("text").agg(F.count("*").alias("times"))
    each = lines.mapInArrow(_counted(buckets, of_lines), kind)
    if order > 1:
        each = each.union(whole.mapInArrow(_counted(buckets, over_newlines), kind))
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain in thousandths, from two tables of counts; there are at most `buckets` rows of either."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, counts in ((s, raw), (t, target)):
        found = counts.toPandas()
        into[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    odds = (t + 1.0) * float(s.sum() + buckets) / ((s + 1.0) * float(t.sum() + buckets))
    return np.floor(UNIT * np.log(odds)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, order: int = ORDER, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, TOGETHER):
            found = Features(*textkit.utf8(batch.column("text")), len(known.value))
            rows = batch.num_rows
            number, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for _, first, bucket in found.by_order(order):
                at = np.searchsorted(first, found.words.row)
                number += np.diff(at)
                weight += textkit.segment_sums(known.value[bucket], at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.words.counts()), pa.array(number), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
        textkit.release()

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def drawn(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighed with score and rank: the highest scores of `percent` of the documents of `least_words` or more; others have no rank."""
    spark = weighed.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-UNIT * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = materialise(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("fit")), "scores")
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = materialise(scored.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), place.alias("place")), "ranks")
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fit").alias("fit")).orderBy("part").collect()  # a row for each partition
    before, number = [], 0
    for part in parts:
        before.append((part.part, number))
        number += part.n
    wanted = percent * sum(part.fit for part in parts) // 100
    starts = spark.createDataFrame(before, "part int, before bigint")
    rank = F.col("before") + F.col("place") + 1
    return ordered.join(F.broadcast(starts), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= wanted, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn."""
    gain = gains(segment_counts(docs, order, buckets), segment_counts(target, order, buckets), buckets)
    return drawn(weigh(docs, gain, order), percent, least_words, seed)


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs.select("doc_id", "text"), target.select("text"))


SQL = r"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), lower AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (SELECT row, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM lower),
target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM words UNION SELECT w FROM target), steps
), s AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (w) GROUP BY bucket),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)
), weights AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM lower LEFT JOIN weights USING (row)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS r, count(*) FILTER (WHERE n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * fit // 100 THEN r END AS rank FROM ranked
"""
