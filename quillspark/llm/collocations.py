"""Phrase collocations by SON partitioning: mined in shards at lowered support, then counted over everything.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and
pieces into words.  Phrases are runs of words within a piece, counted for each
language by itself.

1. Documents are dealt to SHARDS shards by a hash of their id.  A phrase that
   occurs `support` times in all must in some shard reach the share of `support`
   that the shard has of its language's words; that is the shard's own support.
2. Every shard is mined completely: tasks count the fingerprints (48 bits of the
   phrase and its language) of all runs of 1 to 4 words in a few million at a
   time, and send sorted runs of them to the shard's slots, ranges of the
   fingerprint that one task can hold.  What reaches the shard's support there is
   a candidate.  Equal fingerprints only ever add candidates.
3. The union of the candidates, a sieve of bits, goes to all tasks, which count
   the phrases that pass it, byte for byte.  Their sums over all shards are exact.

Scores and the dropping of parts are joins over the table of frequent phrases.

Edge cases: a null text is empty and has no phrases; a null language is `und`;
texts are taken whole, and a task's memory is bound by its longest; rows equal in
id and text count as often as they stand; ties end in the phrase's bytes, so ranks
are the same in each run; null ids fall into one shard; an empty table gives an
empty one; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .repeats import Sieve
from .storage import delete, materialise, written

SUPPORT, LONGEST, COVER, TOP = 30, 4, 80, 2000
SHARDS = 8
#: Runs of words for each slot of a shard, and that a task holds before it sends them on.
SLOT, HELD = 2 << 20, 2 << 20
TOGETHER = 2 << 20
SCALE = 2_000_000

ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[list(b".,;:!?\n\x0b\x0c\r")] = True
NOT_WORD = ENDS_PIECE.copy()
NOT_WORD[list(b" \t")] = True
WORD = r"[^\x09-\x0D .,;:!?]+"

_U = np.uint64
BITS = 48


class Phrases:
    """All runs of 1 to `longest` words within the pieces of a batch; langs: each row's language."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: np.ndarray, longest: int):
        self.words = textkit.Words(textkit.LOWER[buf], off, NOT_WORD)
        n = len(self.words)
        self.row = np.searchsorted(self.words.row, np.arange(n), "right") - 1
        piece = np.cumsum(ENDS_PIECE[buf])[self.words.start] + self.row if n else self.row
        seed = np.array([xxhash.xxh3_64_intdigest(x) for x in langs], _U)
        hashes = self.words.hashes()
        firsts, keys, sizes = [], [], []
        for size in range(1, longest + 1):
            runs = textkit.runs(hashes, size) if size > 1 else hashes
            first = np.flatnonzero(piece[: len(runs)] == piece[size - 1 :]) if len(runs) else np.zeros(0, np.int64)
            firsts.append(first)
            keys.append(textkit.step(runs[first], seed[self.row[first]]))
            sizes.append(np.full(len(first), size, np.int8))
        self.first, self.key, self.size = (np.concatenate(x) for x in (firsts, keys, sizes))


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted fingerprints and their counts, byte plane by byte plane, compressed."""
    gaps = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(gaps.T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(12, -1)
    keys = np.cumsum(np.ascontiguousarray(planes[:8].T).view("<u8").ravel(), dtype=_U)
    return keys, np.ascontiguousarray(planes[8:].T).view("<u4").ravel().astype(np.int64)


def prepared(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(lang, shard, text); nulls replaced."""
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.coalesce("text", F.lit("")).alias("text"))


def shares(texts: DataFrame, support: int, longest: int) -> DataFrame:
    """(lang, shard, n_words, total, least, slots): each shard's words, its language's, its support and slots."""
    words = texts.groupBy("lang", "shard").agg(F.sum(F.regexp_count("text", F.lit(WORD)).cast("bigint")).alias("n_words"))
    total = F.sum("n_words").over(Window.partitionBy("lang"))
    least = F.ceil(support * F.col("n_words").cast("decimal(20,0)") / F.col("total")).cast("bigint")
    return words.withColumn("total", total).filter("n_words > 0").withColumns({"least": least, "slots": F.ceil(longest * F.col("n_words") / SLOT).cast("bigint")})


def runs_of_shards(texts: DataFrame, shared: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, shard, slot, least, runs): counted fingerprints of some of a shard's texts."""
    fields = ["lang", "shard", "slot", "least", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}

        def sent() -> pa.RecordBatch:
            rows = []
            for (lang, shard, least, slots), parts in held.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                slot = (keys.astype(np.float64) * (slots / float(1 << BITS))).astype(np.int64)  # monotone, so a slot is a range
                cuts = np.flatnonzero(np.diff(slot, prepend=-1)).tolist()
                rows += [(lang, shard, int(slot[a]), least, packed(keys[a:b], counts[a:b])) for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in rows], pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("slot", pa.int64()), ("least", pa.int64()), ("runs", pa.binary())]))

        count = 0
        for batch in textkit.pieces(batches, TOGETHER):
            owner = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "least", "slots")), strict=True))
            names = {x: i for i, x in enumerate(dict.fromkeys(owner))}
            found = Phrases(*textkit.utf8(batch.column("text")), np.array([o[0] for o in owner], object), longest)
            which = np.array([names[o] for o in owner])[found.row[found.first]]
            order = np.argsort(which, kind="stable")
            keys, ends = (found.key >> _U(64 - BITS))[order], np.cumsum(np.bincount(which, minlength=len(names)))
            for name, a, b in zip(names, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if b > a:
                    held.setdefault(name, []).append(keys[a:b])
            count += len(keys)
            if count >= HELD:
                yield sent()
                count = 0
                textkit.release()
        if held:
            yield sent()
        textkit.release()

    return texts.join(shared.select("lang", "shard", "least", "slots"), ["lang", "shard"]).mapInArrow(run, "lang string, shard bigint, slot bigint, least bigint, runs binary")


def locally_frequent(runs: DataFrame) -> DataFrame:
    """(key): fingerprints that reach their shard's support, of every shard."""

    def mined(table: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in table.column("runs").to_pylist()]
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        found = keys[at][np.add.reduceat(counts, at) >= table.column("least")[0].as_py()].astype(np.int64)
        del parts, keys, counts, order, at
        textkit.release()
        return pa.table({"key": found})

    return runs.groupBy("lang", "shard", "slot").applyInArrow(mined, "key bigint")


def counted(texts: DataFrame, sieve: Sieve, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, f): the exact counts of all phrases that the sieve lets pass, over all texts."""
    bits, known = sieve.bits, sieve.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = known.value, _U((1 << bits) - 1)
        for batch in textkit.pieces(batches, TOGETHER):
            lang = np.array(batch.column("lang").to_pylist(), object)
            found = Phrases(*textkit.utf8(batch.column("text")), lang, longest)
            k = found.key >> _U(64 - BITS) & mask
            some = np.flatnonzero(table[(k >> _U(6)).astype(np.int64)] >> (k & _U(63)) & _U(1))
            if not len(some):
                continue
            _, at, which = np.unique(found.key[some], return_index=True, return_inverse=True)
            raw, start, end = found.words.joined()
            joined = np.frombuffer(raw, np.uint8)
            a = start[found.first[some]]
            n = end[found.first[some] + found.size[some] - 1] - a
            code = np.unique(lang.astype(str), return_inverse=True)[1][found.row[found.first[some]]]
            # a phrase that isn't its fingerprint's first one, byte for byte, is a row of its own
            same = textkit.equal_slices(joined, a, n, a[at][which], n[at][which]) & (code == code[at][which])
            rows = np.concatenate([at, np.flatnonzero(~same)])
            f = np.concatenate([np.bincount(which[same], minlength=len(at)), np.ones(int((~same).sum()), np.int64)])
            size = np.append(0, np.cumsum(n[rows]))
            text = joined[np.arange(size[-1]) - np.repeat(size[:-1] - a[rows], n[rows])]
            phrase = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(size.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(lang[found.row[found.first[some[rows]]]], pa.string()), phrase, pa.array(found.size[some[rows]].astype(np.int32)), pa.array(f)], ["lang", "phrase", "size", "f"])
            textkit.release()

    return texts.select("lang", "text").mapInArrow(run, "lang string, phrase string, size int, f bigint").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The table (lang, phrase, size, f) of phrases of 1 to `longest` words with f >= support, and the table of shares."""
    texts = prepared(docs, shards)
    shared = materialise(shares(texts, support, longest), "shares")
    found, path = written(locally_frequent(runs_of_shards(texts, shared, longest)), "candidates")
    bits = min(28, max(20, math.ceil(math.log2(16 * max(1, found.count())))))  # at most 32 MB of bits; fuller ones let more pass, and are as right
    phrases = materialise(counted(texts, Sieve(found, "key", bits), longest).filter(F.col("f") >= support), "phrases")
    delete(docs.sparkSession, path)
    return phrases, shared


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): phrases of 2 words or more at their lowest-scoring cut."""
    words = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cuts = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "size", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    side = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) DIV CAST(l + r AS DECIMAL(20,0))")
    best = both.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): of every part, of 2 words or more, of a longer phrase, the count of its most frequent such phrase."""
    words = F.split("phrase", " ")
    longer = phrases.filter("size > 2").select("lang", "f", "size", words.alias("words"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    return longer.select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, cover: int = COVER, top: int | None = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best `top` phrases, or all."""
    phrases, shared = frequent_phrases(docs, support, longest, shards)
    found = scored(phrases).join(covered(phrases), ["lang", "phrase"], "left")
    found = found.filter(F.col("most").isNull() | (100 * F.col("most").cast("decimal(20,0)") < cover * F.col("a").cast("decimal(20,0)")))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    if top is not None:  # each of a language's salts sends its own best ones to the task that ranks it
        some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best))
        found = found.withColumn("some", some).filter(F.col("some") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    totals = shared.groupBy("lang").agg(F.first("total").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def digest(docs: DataFrame) -> DataFrame:
    return collocations(docs.select("doc_id", "text", "lang"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
runs AS (SELECT lang, ws, unnest([1, 2, 3, 4]) AS size FROM split),
every AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM runs WHERE len(ws) >= size),
totals AS (SELECT lang, count(*) AS n FROM every WHERE size = 1 GROUP BY lang),
phrases AS (SELECT lang, phrase, size, count(*) AS f, string_split(phrase, ' ') AS ws FROM every GROUP BY lang, phrase, size HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, size, f AS a, ws, unnest(range(1, size)) AS k FROM phrases WHERE size > 1),
sides AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score FROM cuts c
  JOIN phrases x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ') JOIN phrases y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ')
), best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part, max(f) AS most FROM (
    SELECT lang, f, unnest(list_transform(range(1, size - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS part FROM (SELECT *, unnest(range(2, size)) AS n FROM phrases WHERE size > 2)
  ) GROUP BY lang, part
), kept AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.part = best.phrase WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
