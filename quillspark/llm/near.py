"""Near copies at a Jaccard likeness of LIKENESS or more over sets of word shingles.

What is compared are the links of a method of 64-bit fingerprints (SimHash in the
pipeline) and, since such texts differ in about 10 bits of 64, which it cannot
tell, those of a longer fingerprint: BANDS positional pieces, each a hash of ROWS
least values of the shingle set.  Two texts share a piece with the chance
likeness**ROWS, and none of 40 at 0.8 with the chance 5e-6.

Both only say what is compared: texts that they link, and chains of them, form a
block, and within a block links are decided by the exact likeness of the shingle
sets.  A block of much text is cut into chunks, which some of its texts
visit all; after that only texts outside the block's largest component have to
meet every chunk, so a large group of near copies costs what its texts do.  No
task holds more than two chunks.  What leaves a task is a spanning forest of its
links.

Edge cases: null is the empty text; texts with equal sets are one entry from the
start, those without words included; fewer words than a shingle make one of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .attach import attach
from .components import Forest, components
from .repeats import Sieve
from .sketch import HASH_BITS, SHINGLE
from .storage import kept, materialise, scratch

#: Least likeness of two near copies, as a fraction.
LIKENESS = (4, 5)
BANDS, ROWS = 40, 6
#: Bytes of text in a chunk of a block.
CHUNK = 4 << 20
#: Texts of a block, about, that meet every chunk of it.
SPREAD = 32

_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_MASK = np.uint64((1 << HASH_BITS) - 1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The rows' distinct shingle hashes, ascending within a row, and the offsets of the rows; at most 65,536 rows."""
    row, found = textkit.shingles(textkit.Words(buf, off), size, lower=True)
    keys = np.sort(row.astype(np.uint64) << np.uint64(HASH_BITS) | found >> np.uint64(64 - HASH_BITS))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys & _MASK, np.searchsorted(keys, np.arange(len(off), dtype=np.uint64) << np.uint64(HASH_BITS))


def pieces(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS positional pieces (uint64) for each set that isn't empty."""
    starts = at[:-1][np.diff(at) > 0]
    x = textkit.mix(hashes).astype(np.uint32)
    made = np.zeros((len(starts), BANDS), np.uint64)
    for i in range(BANDS * ROWS if len(starts) else 0):
        least = np.minimum.reduceat(x * _TIMES[i] + _PLUS[i], starts)
        made[:, i // ROWS] = textkit.mix(made[:, i // ROWS] + least + np.uint64(i + 1 << 32))
    return made


def entries(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[pa.Array]:
    """For each row the hash of its shingle set, and its pieces."""
    hashes, at = shingle_sets(buf, off, size)
    mark = textkit.mix(textkit.segment_sums(textkit.mix(hashes).view(np.int64), at).view(np.uint64))
    held = np.append(0, np.cumsum(np.where(np.diff(at) > 0, BANDS, 0))).astype(np.int32)
    return [pa.array(mark.view(np.int64)), pa.ListArray.from_arrays(pa.array(held), pa.array(pieces(hashes, at).ravel().view(np.int64)))]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of the ranges that start at `first`, one range after another."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def linked(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among sets of at least LIKENESS.

    With the hashes ordered from rare to frequent, two sets of that likeness
    share one of their first (1 - likeness) * size + 1 hashes, so only sets that
    meet there are compared.  A link between two components has an end outside
    the largest one, so only sets outside it ask.
    """
    n, (up, down) = len(sets), LIKENESS
    tree, sizes = Forest(n), np.array([len(s) for s in sets], np.int64)
    off = np.append(0, np.cumsum(sizes))
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rare = np.empty(len(count), np.int64)
    rare[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(n), sizes)
    held = rare[number]
    held = held[np.lexsort((held, owner))]
    lead = np.arange(len(held)) - off[owner] < (sizes - -(-up * sizes // down) + 1)[owner]
    asked, who = held[lead], owner[lead]
    own = np.searchsorted(who, np.arange(n + 1))
    order = np.argsort(asked, kind="stable")
    listed, first = who[order], np.searchsorted(asked[order], np.arange(len(count) + 1))
    flag = np.zeros(len(count), bool)
    root, most = np.arange(n), -1
    for i in range(n):
        if root[i] == most:
            continue
        mine = asked[own[i] : own[i + 1]]
        met = np.unique(listed[ranges(first[mine], first[mine + 1] - first[mine])])
        met = met[(root[met] != root[i]) & (sizes[met] * down >= up * sizes[i]) & (sizes[i] * down >= up * sizes[met])]
        if not len(met):
            continue
        flag[held[off[i] : off[i + 1]]] = True
        shared = np.add.reduceat(flag[held[ranges(off[met], sizes[met])]], np.append(0, np.cumsum(sizes[met])[:-1]), dtype=np.int64)
        flag[held[off[i] : off[i + 1]]] = False
        near = met[(up + down) * shared >= up * (sizes[met] + sizes[i])]
        if len(near):
            tree.join(np.full(len(near), i), near)
            root = tree.root(np.arange(n))
            most = int(np.argmax(np.bincount(root)))
    return tree.links()


def compared(members: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Edges (a, b) among the marks of members (root, part, other, mark, text) that meet in a task."""
    names = ("root", "part", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, marks, sets = None, [], []
        for batch in textkit.pieces(batches, 1 << 20):
            keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            hashes, at = shingle_sets(*textkit.utf8(batch.column("text")), size)
            for i, mark in enumerate(batch.column("mark").to_pylist()):
                if keys[i] != key:
                    yield from done(marks, sets)
                    key, marks, sets = keys[i], [], []
                marks.append(mark)
                sets.append(hashes[at[i] : at[i + 1]].copy())
        yield from done(marks, sets)
        marks = sets = None
        textkit.release()

    def done(marks: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(marks) > 1:
            a, b = linked(sets)
            if len(a):
                known = np.array(marks, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(known[a]), pa.array(known[b])], ["a", "b"])

    return members.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a bigint, b bigint")


def bit_links(rows: DataFrame, linked_bits: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) among the marks of rows (mark, bits) whose bits are equal or linked by linked_bits(table of distinct bits)."""
    held = materialise(rows.select("mark", "bits").distinct(), "near-bits")
    least = materialise(held.groupBy("bits").agg(F.min("mark").alias("least")), "near-bit-marks")
    same = held.join(least, "bits").filter("mark <> least").select(F.col("mark").alias("a"), F.col("least").alias("b"))
    ends = [least.select(F.col("bits").alias(x), F.col("least").alias(f"{x}_mark")) for x in ("a", "b")]
    over = linked_bits(least.select("bits")).join(ends[0], "a").join(ends[1], "b").select(F.col("a_mark").alias("a"), F.col("b_mark").alias("b"))
    return same.union(over)


def links(rows: DataFrame, prints: DataFrame, size: int = SHINGLE, chunk: int = CHUNK, more: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that connect marks exactly as the links among texts that share a piece or an edge of `more`, or a chain of them, do."""
    each = prints.select("mark", F.explode("pieces").alias("piece"))
    least = each.groupBy("piece").agg(F.min("mark").alias("least"), F.count("*").alias("n")).filter("n > 1")
    star = each.join(least, "piece").filter("mark <> least").select(F.col("mark").alias("a"), F.col("least").alias("b"))
    blocks = components(star if more is None else star.union(more), "near-blocks").withColumnRenamed("node", "mark")
    known = materialise(prints.select("mark", "row", "bytes").join(blocks, "mark"), "near-members")
    texts = Sieve(known, "mark").passed(rows.select("row", "mark", "text"), "mark")
    cut = materialise(known.groupBy("root").agg(F.greatest(F.ceil(F.sum("bytes") / chunk), F.lit(1)).cast("int").alias("parts"), F.count("*").alias("n")), "near-cuts")
    own = known.join(cut, "root").withColumn("own", F.pmod(F.xxhash64("mark"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    usual = F.pmod(F.xxhash64("mark", F.lit(1)), F.col("n")) < SPREAD
    spread = own.filter(F.col("parts") > 1).filter(usual).select("row", "root", "own", every.alias("part")).filter("part <> own").drop("own")
    dealt = own.select("row", "root", F.col("own").alias("part")).union(spread.select("row", "root", "part")).withColumn("other", F.lit(-1))
    meet = lambda d: compared(texts.join(d, "row").select("root", "part", "other", "mark", "text"), size)
    found = materialise(meet(dealt), "near-edges")
    large = own.filter(F.col("parts") > 1)
    if large.isEmpty():
        return found
    # of blocks with several parts, what is outside the largest component meets every part
    joined = large.join(components(found, "near-parts").withColumnsRenamed({"node": "mark", "root": "group"}), "mark", "left").withColumn("group", F.coalesce("group", "mark"))
    most = joined.groupBy("root", "group").agg(F.count("*").alias("k")).groupBy("root").agg(F.max(F.struct("k", "group"))["group"].alias("most"))
    outside = materialise(joined.join(most, "root").filter("group <> most").select("mark", "row", "root", "bytes", "own", "parts"), "near-outside")
    dealt_out = outside.groupBy("root").agg(F.ceil(F.sum("bytes") / chunk).cast("int").alias("others"))
    asks = outside.join(dealt_out, "root").select("row", "root", every.alias("part"), F.pmod(F.xxhash64("mark", F.lit(2)), F.col("others")).cast("int").alias("other"))
    told = large.join(dealt_out, "root").select("row", "root", F.col("own").alias("part"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    return found.union(meet(asks.union(told).distinct()))


def least_of_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SHINGLE, chunk: int = CHUNK, bits: tuple[Callable, Callable] | None = None) -> DataFrame:
    """(doc_id): of each component of near copies the least id; null ids are passed over.

    bits: a method's fingerprints(docs, name), which adds a struct with the field `bits`, and its links(table of bits), edges (a, b) among those.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = attach(base, "near", "struct<mark:bigint,pieces:array<bigint>>", lambda buf, off: entries(buf, off, size))
    if bits:
        found = bits[0](found, "coarse")
    with scratch(docs.sparkSession):
        rows = materialise(found.select("row", "doc_id", "text", "near.mark", "near.pieces", *(["coarse.bits"] if bits else [])), "near")
        # equal sets have equal pieces; the text is that of one of them
        one = rows.groupBy("mark").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.first("pieces").alias("pieces"), F.max(F.octet_length("text")).alias("bytes"))
        prints = materialise(one, "near-prints")
        whole = components(links(rows, prints, size, chunk, bit_links(rows, bits[1]) if bits else None), "near-links").withColumnRenamed("node", "mark")
        rooted = prints.select("mark", "least").join(whole, "mark", "left")
        return kept(rooted.groupBy(F.coalesce("root", "mark").alias("root")).agg(F.min("least").alias("doc_id")).select("doc_id"), "near-least")
