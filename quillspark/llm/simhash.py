"""SimHash near-dedup through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of
their 8 bytes, so they share at least 5 bytes in place: the guaranteed minimum.
A posting list for each (position, byte) would pair a 256th of all documents, so
a list fixes the bytes of 4 positions.  Every 3 positions lie in exactly one of
14 sets of 4 (the points of a 3-dimensional space over two elements, four with
sum zero), hence every pair to be linked shares the other 4 positions' list.
Within a list the bytes of its free positions are tallied: only members that
share one of them as well, the fifth, are compared, and pairs are verified by
their differing bits.

Equal fingerprints are one entry from the start, and what leaves a list is a
spanning forest of its links, never all of its pairs.  A list of many members
probes their neighbours instead of comparing them pairwise.

Edge cases: null is the empty text; no words give the fingerprint zero, which
links like any other; fewer than three words make one shingle; rows with equal
ids or texts are separate rows with equal results; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near, textkit
from .attach import attach
from .components import Forest, components
from .storage import kept, materialise, scratch

BITS = 3
SEED = 42

#: The positions that each kind of list fixes; the complement of a set is a set too.
FIXED = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
MASKS = np.array([sum(0xFF << (8 * i) for i in c) for c in FIXED], np.uint64)
_PAIRWISE = 4096


def majority(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes: bit i is set if it is set in over half of them."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def simhashes(buf: np.ndarray, off: np.ndarray, size: int = 3) -> list[int]:
    """One fingerprint for each row; rows without words have 0."""
    words = textkit.Words(buf, off)
    joined, start, end = words.joined(lower=True)
    starts, ends = start.tolist(), end.tolist()
    digest, found = xxhash.xxh64_intdigest, []
    for a, b in zip(words.row[:-1].tolist(), words.row[1:].tolist(), strict=True):
        if a == b:
            found.append(0)
        elif b - a < size:
            found.append(digest(joined[starts[a] : ends[b - 1]], SEED))
        else:
            found.append(majority(np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a : b - size + 1], ends[a + size - 1 : b], strict=True)], np.uint64)))
    return found


def fingerprints(docs: DataFrame, name: str = "simhash", text: str = "text", size: int = 3) -> DataFrame:
    """docs with the struct column `name` whose field `bits` is the fingerprint as a signed 64-bit integer."""

    def make(buf, off):
        found = simhashes(buf, off, size)
        return [np.array(found, np.uint64).astype(np.int64)]

    return attach(docs, name, "struct<bits:bigint>", make, text)


def forest(members: np.ndarray, fixed: tuple[int, ...], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints that share a posting list.

    Members that share one more positional byte are compared in blocks; of many
    such members each probes its neighbours in the free bits, so that the work
    stays linear in the list.
    """
    n = len(members)
    tree = Forest(n)
    for position in set(range(8)) - set(fixed) if n > 2 else (None,):
        byte = members >> np.uint64(8 * position) & np.uint64(0xFF) if position is not None else np.zeros(n, np.uint64)
        order = np.argsort(byte, kind="stable")
        edges = np.append(0, np.flatnonzero(np.append(byte[order][1:] != byte[order][:-1], True)) + 1)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            group = order[a:b]
            if len(group) > _PAIRWISE:
                _probe(tree, members, group, bits)
                continue
            for at in range(0, len(group), 256) if len(group) > 1 else ():
                x, y = np.nonzero(np.bitwise_count(members[group[at : at + 256], None] ^ members[None, group]) <= bits)
                tree.join(group[x + at], group[y])
    a, b = tree.links()
    return members[a], members[b]


def _probe(tree: Forest, members: np.ndarray, group: np.ndarray, bits: int) -> None:
    """Joins the group's members with those that differ in at most `bits` of the bits that vary in it."""
    group = group[np.argsort(members[group])]
    known = members[group]
    varied = int(np.bitwise_or.reduce(known ^ known[0]))
    free = [i for i in range(64) if varied >> i & 1]
    for r in range(1, bits + 1):
        for flips in combinations(free, r):
            other = known ^ np.uint64(sum(1 << i for i in flips))
            at = np.minimum(np.searchsorted(known, other), len(known) - 1)
            hit = np.flatnonzero(known[at] == other)
            tree.join(group[hit], group[at[hit]])


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column `bits`) exactly as the links of at most 3 bits do."""
    entries = prints.select("bits", F.posexplode(F.array(*[F.col("bits").bitwiseAND(F.lit(int(m.astype(np.int64)))) for m in MASKS])).alias("list", "shared"))
    dealt = entries.repartition("list", "shared").sortWithinPartitions("list", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the last list, which the next batch may go on with
        for batch in batches:
            now = tuple(np.asarray(batch.column(c)).astype(np.int64) for c in ("list", "shared", "bits"))
            edge = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            if held and (now[0][0], now[1][0]) != (held[0][0][0], held[0][1][0]):
                edge = np.append(0, edge)
            if len(edge):
                cut = int(edge[-1])
                yield from found(*(np.concatenate([*(h[i] for h in held), now[i][:cut]]) for i in range(3)))
                held, now = [], tuple(x[cut:] for x in now)
            held.append(now)
        if held:
            yield from found(*(np.concatenate([h[i] for h in held]) for i in range(3)))
        held = []
        textkit.release()

    def found(kind: np.ndarray, shared: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.append(0, np.flatnonzero((kind[1:] != kind[:-1]) | (shared[1:] != shared[:-1])) + 1)
        edges = np.append(edges, len(bits))
        many = np.flatnonzero(np.diff(edges) > 1)
        pairs = [forest(bits[edges[i] : edges[i + 1]].astype(np.uint64), FIXED[int(kind[edges[i]])]) for i in many.tolist()]
        if pairs:
            a, b = (np.concatenate([p[j] for p in pairs]).astype(np.int64) for j in (0, 1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(id, bits, component_id) for each row: the least id that its links reach, itself included; null ids are passed over."""
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    rows = materialise(fingerprints(base, "simhash", "text", size).select("doc_id", F.col("simhash.bits").alias("bits")), "simhash")
    with scratch(docs.sparkSession):
        prints = materialise(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "simhash-prints")
        found = components(links(prints), "simhash-links").withColumnRenamed("node", "bits")
        rooted = prints.join(found, "bits", "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = kept(rooted.join(least, "root").select("bits", "component_id"), "simhash-components")
    return rows.join(named, "bits").select("doc_id", "bits", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies the document with the least id stays; its repeated rows become one.

    The links of the fingerprints' lists are compared exactly, along with those that near adds beyond BITS bits.
    """
    keep = near.least_of_components(docs.filter("doc_id is not null"), bits=(fingerprints, links)).distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id is null")).select(*[f"`{c}`" for c in docs.columns])
