"""Packing token sequences by first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt to randomised groups of about GROUP_DOCS documents or
GROUP_BYTES of text, and each group is packed by itself, so that no task knows
more than a group.  A document's ids, with one id at its end, are cut into whole
sequences and a rest.  The rests go into bins, longest first, each into the
first bin that has room: every inner node of the tree holds the most room below
it, so that bin is found from the root in one step a level.

Padding that is left is filled by cutting: the emptiest bins' pieces fill the
fullest bins' gaps of SHRED ids or more.  What the last bin then holds is cut
into powers of two, since a sequence of such a length isn't padded.

Edge cases: a null text is empty, and an empty text is its end alone; a very long
text makes a large group, which one task holds; rows equal in id and text are
packed as documents of their own, in any group; null ids are an id; an empty
table gives an empty table; of extra columns none is read.  Ties of length go by
place in the group.  Groups follow a document's id and its row's place, so on a
retry documents must come in the same order: a table does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, textkit

LENGTH = 1024
GROUP_DOCS, GROUP_BYTES = 2048, 32 << 20
#: A gap of fewer ids is padded rather than filled by cutting a document once more.
SHRED = 16
END = 0
SEED = 13
#: Distinct pieces of text that a worker keeps, and bytes of text that it encodes at a time: these bound its memory.
CACHED, TOGETHER = 400_000, 2 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The ids of a byte-level BPE in the JSON form of the tokenizers library; special tokens' strings are ordinary text.

    Texts are cut by bpe's vectorised scan; each distinct piece is merged once and kept.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            names = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow code point 255
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        ranks = {bytes(byte[c] for c in name): i for name, i in names.items() if all(c in byte for c in name)}
        ranks.pop(b"<|endoftext|>", None)
        self.merges = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[bytes, bytes] = {}

    def batch(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and the range of each text's."""
        start, row = bpe.piece_ranges(buf, off)
        end = np.append(start[1:], len(buf)) if len(start) else start
        names, which = bpe.distinct_pieces(buf.tobytes(), buf, start, end)
        if len(self.cache) > CACHED:
            self.cache.clear()
        known, ids = self.cache, []
        for name in names:
            made = known.get(name)
            if made is None:
                made = np.array(self.merges.encode_ordinary(name.decode()), "<u4").tobytes()
                if len(name) <= bpe.LONGEST_CACHED:
                    known[name] = made
            ids.append(made)
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        base, n = np.cumsum(size) - size, size[which]
        total = np.append(0, np.cumsum(n))
        return flat[np.arange(total[-1]) - np.repeat(total[:-1] - base[which], n)], total[row]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def first_fit_decreasing(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each item, none longer than `length`; bins are opened in order."""
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [length] * (2 * leaves)  # a node's children are 2i and 2i + 1, and it has the most room of them
    chosen = np.zeros(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        chosen[item] = node - leaves
        room[node] -= size
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return chosen


Piece = tuple[int, int, int]  # document, start, length


def pack_group(totals: list[int], length: int = LENGTH, shred: int = SHRED) -> list[list[Piece]]:
    """Sequences, as lists of pieces, of documents that have so many ids."""
    full = [[(i, at, length)] for i, n in enumerate(totals) for at in range(0, n - n % length, length)]
    rests = [(i, n - n % length, n % length) for i, n in enumerate(totals) if n % length]
    bins: list[list[Piece]] = []
    for rest, at in zip(rests, first_fit_decreasing(np.array([r[2] for r in rests], np.int64), length).tolist(), strict=True):
        bins.extend([] for _ in range(at + 1 - len(bins)))
        bins[at].append(rest)
    loads = [sum(p[2] for p in b) for b in bins]
    padded = lambda n: n & (n - 1)  # noqa: E731  a power of two is not
    order = sorted((k for k in range(len(bins)) if loads[k] < length and padded(loads[k])), key=lambda k: -loads[k])
    fullest, emptiest = 0, len(order) - 1
    while fullest < emptiest:
        to, of = order[fullest], order[emptiest]
        gap = length - loads[to]
        if gap < shred:
            fullest += 1
            continue
        while gap and bins[of]:
            doc, start, n = bins[of].pop()
            take = min(gap, n)  # a piece's end goes
            if take < n:
                bins[of].append((doc, start, n - take))
            bins[to].append((doc, start + n - take, take))
            loads[to], loads[of], gap = loads[to] + take, loads[of] - take, gap - take
        if not bins[of]:
            emptiest -= 1
        if not gap:
            fullest += 1
    last = order[fullest] if order and fullest == emptiest else None
    made = full + [b for k, b in enumerate(bins) if b and k != last]
    if last is not None:
        made += [bins[last]] if length - loads[last] < shred else powers(bins[last], loads[last])
    return made


def powers(pieces: list[Piece], load: int) -> list[list[Piece]]:
    """The pieces in order, cut into sequences whose lengths are the powers of two that their sum is made of."""
    out, left = [], list(reversed(pieces))
    for bit in reversed(range(load.bit_length())):
        room = load & 1 << bit
        if room:
            out.append([])
        while room:
            doc, start, n = left.pop()
            take = min(room, n)
            out[-1].append((doc, start, take))
            room -= take
            if take < n:
                left.append((doc, start + take, n - take))
    return out


FIELDS = "doc_id {0}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, length: int = LENGTH, text: str = "text", path: str | None = None, group_docs: int = GROUP_DOCS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids: little-endian unsigned 32-bit numbers.

    path: the tokenizer's JSON file, which every executor can read at that place.
    """
    where = path or default_path()
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    groups = max(1, -(-n // group_docs), -(-size // group_bytes))
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(SEED), F.monotonically_increasing_id()), F.lit(groups))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(where)
        for batch in textkit.pieces(batches, TOGETHER):
            flat, at = ids.batch(*textkit.utf8(batch.column("text")))
            small = flat.astype("<u2") if not len(flat) or flat.max() < 1 << 16 else flat
            made = [small[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("doc_id"), pa.array(np.diff(at)), pa.array(made, pa.binary())], ["grp", "doc_id", "n", "ids"])
        textkit.release()

    def packed(table: pa.Table) -> pa.Table:
        group, totals = table.column("grp")[0].as_py(), [k + 1 for k in table.column("n").to_pylist()]
        whole = []
        for k, raw in zip(totals, table.column("ids").to_pylist(), strict=True):
            ids = np.full(k, END, "<u4")
            ids[:-1] = np.frombuffer(raw, "<u2" if len(raw) == 2 * (k - 1) else "<u4")
            whole.append(ids)
        rows = [(doc, start, size, sequence, first) for sequence, pieces in enumerate(pack_group(totals, length)) for (doc, start, size), first in zip(pieces, np.cumsum([0] + [p[2] for p in pieces]).tolist(), strict=False)]
        doc, start, size, sequence, first = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        ids = pa.array([whole[d][s : s + m].tobytes() for d, s, m, *_ in rows], pa.binary())
        made = [table.column("doc_id").combine_chunks().take(pa.array(doc)), pa.array(start), pa.array(size), ids, pa.array(np.array(totals, np.int64)[doc]), pa.array((group << 32) + sequence), pa.array(first)]
        return pa.Table.from_arrays(made, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    tokens = docs.select("doc_id", F.col(text).alias("text"), dealt.alias("grp")).mapInArrow(encode, f"grp bigint, doc_id {kind}, n bigint, ids binary")
    return tokens.groupBy("grp").applyInArrow(packed, FIELDS.format(kind))


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """(sequence_id, ids, n_padding): the packed rows themselves, in the form of pieces' ids, padded to `length` unless they have a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    n = F.sum("length")
    short = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0).cast("bigint")).otherwise(F.lit(length) - n)
    each = pieces.groupBy("sequence_id").agg(joined.alias("ids"), n.alias("n"), short.alias("n_padding"))
    return each.select("sequence_id", F.rpad("ids", (4 * (F.col("n") + F.col("n_padding"))).cast("int"), F.lit(pad.to_bytes(4, "little"))).alias("ids"), "n_padding")


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
