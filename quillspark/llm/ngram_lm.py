"""LM scoring with n-gram counts in Elias-Fano tries.

The model is a bigram model with a Dirichlet prior on the unigram model:

    P(w | v) = (c(v, w) + MU * P(w)) / (c(v) + MU)
    P(w)     = (c(w) + 1) / (N + V + 1)

which sums to one over the V known words, the end token and one unknown word.
c(v, w) counts what follows v in the training texts; a text's first token
follows the start, which is counted as a word of its own.

Counts come from one exchange.  Each block of documents asks for its distinct
words and distinct word pairs only, so frequent ones are combined before the
shuffle.  A shard counts the training occurrences that all blocks report for its
keys, builds its trie, answers each block's keys in the order asked, and the
block scores its texts from the answers.  Pairs are dealt by their first word
and a salt of the second, so that a frequent word spreads over SALTS shards.

A trie's first level has the contexts, its second their successors.  Both are
Elias-Fano coded in memory-mapped files of the task; successors are coded
relative to their context's range, between monotone pointers, and found by
successor search in that range.  Its values are quantised logarithms of the pair
counts: a salted context's total is known in no single shard, so the prior is
added when a block reads them.  Words are known by 64-bit hashes.

Blocks are cut twice, so docs must be read alike twice: a table does, a shuffle
does not (a block without answers fails rather than score wrongly).

Edge cases: a null text is empty and has the end token alone; texts without
words likewise; repeated rows count as often as they stand; with no training
text N and V are zero and every token is unknown; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .storage import materialise

MU = 60.0
SALTS = 16
#: Bytes of text in a block.
BLOCK = 8 << 20
END = np.uint64(0x7F4A7C159E3779B9)
START = np.uint64(0x2545F4914F6CDD1D)
#: Steps of a quantised log10 in one decade; codes are 16 bits, 0 is "not in the trie".
STEPS = 6000


class EliasFano:
    """A monotone sequence: low bits packed in bytes, high bits in unary with a rank directory."""

    def __init__(self, values: np.ndarray, folder: str, name: str):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        width = (self.low_bits + 7) // 8
        low = values & np.uint64((1 << self.low_bits) - 1)
        packed = low.view(np.uint8).reshape(-1, 8)[:, :width] if self.n else np.zeros((0, width), np.uint8)
        at = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)
        bits = np.zeros((int(at[-1]) + 64) // 64 * 64 if self.n else 64, np.uint8)
        bits[at] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.low, self.high = _mapped(packed, folder, f"{name}.low"), _mapped(words, folder, f"{name}.high")
        self.ahead = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))  # ones before each word of high bits
        self.zeros = np.arange(len(self.ahead)) * 64 - self.ahead
        self.top = int(values[-1] >> np.uint64(self.low_bits)) if self.n else 0

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i, by select on the high bits."""
        word = np.searchsorted(self.ahead, i, "right") - 1
        left = (i - self.ahead[word]).astype(np.int64)
        bits = np.asarray(self.high[word])
        place = word * 64 + _select(bits, left)
        low = np.zeros(len(i), np.uint64)
        for b in range(self.low.shape[1]):
            low |= np.asarray(self.low[i, b]).astype(np.uint64) << np.uint64(8 * b)
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | low

    def below(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part under h: the place of the h-th zero, by select on the zeros."""
        out = np.full(len(h), self.n, np.int64)
        out[h == 0] = 0
        some = np.flatnonzero((h > 0) & (h <= self.top))
        k = h[some].astype(np.int64) - 1
        word = np.searchsorted(self.zeros, k, "right") - 1
        out[some] = word * 64 + _select(~np.asarray(self.high[word]), k - self.zeros[word]) - k
        return out

    def successor(self, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Of each range first .. last - 1 the least place whose value isn't below `value`, or last.

        Only the values with the same high part, two on average, are searched.
        """
        h = value >> np.uint64(self.low_bits)
        start, stop = self.below(h), self.below(h + np.uint64(1))
        a = np.clip(start, first, last).astype(np.int64)
        b = np.clip(stop, first, last).astype(np.int64)
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            mid = (a[open_] + b[open_]) >> 1
            below = self.access(mid) < value[open_]
            a[open_[below]] = mid[below] + 1
            b[open_[~below]] = mid[~below]


def _mapped(values: np.ndarray, folder: str, name: str) -> np.ndarray:
    """The array as a memory-mapped file of the folder."""
    if not values.size:
        return values
    path = os.path.join(folder, name)
    np.ascontiguousarray(values).tofile(path)
    return np.memmap(path, values.dtype, "r", shape=values.shape)


def _select(bits: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 0) of each 64-bit word, by halving."""
    place, k = np.zeros(len(bits), np.int64), k.copy()
    for half in (32, 16, 8, 4, 2, 1):
        lower = np.bitwise_count(bits & np.uint64((1 << half) - 1)).astype(np.int64)
        up = k >= lower
        k -= np.where(up, lower, 0)
        place += np.where(up, half, 0)
        bits = np.where(up, bits >> np.uint64(half), bits)
    return place


class Trie:
    """Contexts and their successors with quantised logarithms of counts.

    pairs: (context, successor) in ascending order, without repeats; codes: their quantised values.
    """

    def __init__(self, context: np.ndarray, successor: np.ndarray, codes: np.ndarray, folder: str):
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.zeros(0, np.int64)
        self.vocabulary = np.unique(successor)
        rank = np.searchsorted(self.vocabulary, successor).astype(np.uint64)
        self.span = np.uint64(max(1, len(self.vocabulary)))
        base = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.append(starts, len(context))))
        self.contexts = EliasFano(context[starts] >> np.uint64(1), folder, "contexts")
        self.pointers = EliasFano(np.append(starts, len(context)), folder, "pointers")
        self.successors = EliasFano(base * self.span + rank, folder, "successors")  # a context's own range holds its ranks
        self.codes = _mapped(codes, folder, "codes")
        self.size = len(starts)

    def find(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The codes of pairs in ascending order; 0 where the trie has none."""
        found = np.zeros(len(context), np.uint16)
        if not self.size or not len(context):
            return found
        new = np.append(True, context[1:] != context[:-1])
        which, key = np.cumsum(new) - 1, context[new] >> np.uint64(1)
        at = self.contexts.successor(np.zeros(len(key), np.int64), np.full(len(key), self.size), key)
        have = at < self.size
        have[have] = self.contexts.access(at[have]) == key[have]
        first, last = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        first[have] = self.pointers.access(at[have])
        last[have] = self.pointers.access(at[have] + 1)
        rank = np.minimum(np.searchsorted(self.vocabulary, successor), len(self.vocabulary) - 1)
        ok = np.flatnonzero(have[which] & (self.vocabulary[rank] == successor))
        value = at[which[ok]].astype(np.uint64) * self.span + rank[ok].astype(np.uint64)
        end = last[which[ok]]
        place = self.successors.successor(first[which[ok]], end, value)
        hit = place < end
        hit[hit] = self.successors.access(place[hit]) == value[hit]
        found[ok[hit]] = self.codes[place[hit]]
        return found


def quantise(counts: np.ndarray) -> np.ndarray:
    """log10 of counts in 16-bit steps; count 1 is code 1."""
    return np.minimum(65535, np.round(np.log10(counts) * STEPS) + 1).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((codes.astype(float) - 1) / STEPS), 0.0)


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: a count, then for each its length, and zstandard's frame."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return _PACK.compress(head + b"".join(parts))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = _UNPACK.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


class Block:
    """Distinct words and pairs of a block of texts, and where they stand."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, held: np.ndarray, shards: int):
        words = textkit.Words(buf, off)
        n, rows = words.counts(), len(held)
        hashes = words.hashes(lower=True)
        end = np.append(0, np.cumsum(n + 1))  # tokens of each row, its end token included
        tokens = np.full(int(end[-1]), END, np.uint64)
        inside = np.ones(len(tokens), bool)
        inside[end[1:] - 1] = False
        tokens[inside] = hashes
        self.row = np.repeat(np.arange(rows), n + 1)
        self.known, self.word = np.unique(tokens, return_inverse=True)
        trained = ~held[self.row]
        start = len(self.known)
        before = np.empty(len(tokens), np.int64)
        before[1:] = self.word[:-1]
        before[end[:-1]] = start
        pair = before * (start + 1) + self.word
        keys, self.pair = np.unique(pair, return_inverse=True)
        self.first, self.second = keys // (start + 1), keys % (start + 1)
        self.word_count = np.bincount(self.word, trained, len(self.known)).astype(np.uint32)
        self.pair_count = np.bincount(self.pair, trained, len(keys)).astype(np.uint32)
        self.names = np.append(self.known, START)
        self.shards = shards
        # of each distinct word and pair the shard; within a shard pairs stay in the order of their hashes
        self.word_shard = (textkit.mix(self.known) % np.uint64(shards)).astype(np.int64)
        a, b = self.names[self.first], self.names[self.second]
        self.pair_shard = (textkit.mix(a + textkit.mix(b) % np.uint64(SALTS)) % np.uint64(shards)).astype(np.int64)
        self.word_order = np.argsort(self.word_shard, kind="stable")
        self.pair_order = np.lexsort((b, a, self.pair_shard))

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """For each shard with any of the block's keys, those keys and their training counts."""
        wo, po = self.word_order, self.pair_order
        w = np.searchsorted(self.word_shard[wo], np.arange(self.shards + 1))
        p = np.searchsorted(self.pair_shard[po], np.arange(self.shards + 1))
        for s in np.union1d(self.word_shard, self.pair_shard).tolist():
            ws, ps = wo[w[s] : w[s + 1]], po[p[s] : p[s + 1]]
            a = self.names[self.first[ps]]
            starts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(a))).astype(np.uint32)
            yield s, pack(self.known[ws], self.word_count[ws], a[starts], sizes, self.names[self.second[ps]], self.pair_count[ps])

    def postings(self) -> bytes:
        """What scoring needs besides the answers, in the order of the questions."""
        place_w, place_p = np.empty(len(self.word_order), np.uint32), np.empty(len(self.pair_order), np.uint32)
        place_w[self.word_order] = np.arange(len(place_w), dtype=np.uint32)
        place_p[self.pair_order] = np.arange(len(place_p), dtype=np.uint32)
        first = np.where(self.first < len(place_w), place_w[np.minimum(self.first, len(place_w) - 1)], len(place_w)).astype(np.uint32)
        # tokens sorted by row and pair: repeats within a row are counted once with their number
        key, n = np.unique(self.row.astype(np.int64) << 32 | place_p[self.pair], return_counts=True)
        rows = np.searchsorted(key, np.arange(int(self.row[-1]) + 2 if len(self.row) else 1, dtype=np.int64) << 32).astype(np.uint32)
        pair = (key & 0xFFFFFFFF).astype(np.uint32)
        step = np.diff(pair, prepend=np.uint32(0)).astype(np.uint32)  # ascending within a row, so mostly small
        columns = [np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4)[:, i]) for i in range(4)]
        order = self.pair_order
        return pack(rows, *columns, np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.uint32), first[order], place_w[self.second[order]])


def answers(blobs: list[bytes], folder: str) -> tuple[list[bytes], int, int]:
    """The shard's replies to its blocks' questions, and its share of N and V."""
    asked = [unpack(b, np.uint64, np.uint32, np.uint64, np.uint32, np.uint64, np.uint32) for b in blobs]
    words = np.concatenate([q[0] for q in asked])
    known, which = np.unique(words, return_inverse=True)
    count = np.bincount(which, np.concatenate([q[1] for q in asked]), len(known)).astype(np.int64)
    context = np.concatenate([np.repeat(q[2], q[3]) for q in asked])
    successor = np.concatenate([q[4] for q in asked])
    times = np.concatenate([q[5] for q in asked]).astype(np.int64)
    order = np.lexsort((successor, context))
    a, b = context[order], successor[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    total = np.add.reduceat(times[order], starts) if len(starts) else times
    a, b, seen = a[starts], b[starts], total > 0
    trie = Trie(a[seen], b[seen], quantise(total[seen]), folder)
    codes = np.empty(len(order), np.uint16)
    codes[order] = trie.find(a, b)[np.cumsum(new) - 1]  # each distinct pair is asked once
    at_p = np.append(0, np.cumsum([len(q[4]) for q in asked]))
    at_w = np.append(0, np.cumsum([len(q[0]) for q in asked]))
    replies = []
    for i in range(len(asked)):
        replies.append(pack(count[which[at_w[i] : at_w[i + 1]]].astype(np.uint64), codes[at_p[i] : at_p[i + 1]]))
    return replies, int(count.sum()), int((count > 0).sum())


def score_block(postings: bytes, replies: list[bytes], total: int, distinct: int, started: int, mu: float = MU) -> tuple[np.ndarray, ...]:
    """For each row: tokens, known tokens, base score, model score."""
    rows, c0, c1, c2, c3, n, more, first, second = unpack(postings, np.uint32, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, np.uint32, np.uint32, np.uint32)
    got = [unpack(r, np.uint64, np.uint16) for r in replies]
    count = np.concatenate([g[0] for g in got]).astype(float)
    joint = restored(np.concatenate([g[1] for g in got]))
    base = (count + 1) / (total + distinct + 1)
    context = np.append(count, float(started))[first]
    log_model = np.log10((joint + mu * base[second]) / (context + mu))
    step = c0.astype(np.uint32) | c1.astype(np.uint32) << np.uint32(8) | c2.astype(np.uint32) << np.uint32(16) | c3.astype(np.uint32) << np.uint32(24)
    pair = np.cumsum(step, dtype=np.uint32)
    times = n.astype(np.int64)
    times[n == 255] = more
    edges = rows.astype(np.int64)
    word = second[pair]
    each = lambda x: np.add.reduceat(np.append(x, 0), edges[:-1]) if len(edges) > 1 else np.zeros(0)  # noqa: E731  every row has its end token
    return each(times), each(times * (count[word] > 0)), each(times * np.log10(base)[word]), each(times * log_model[pair])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def blocks(docs: DataFrame, shards: int, what: str) -> DataFrame:
    """Blocks of (doc_id, text, held) rows: their questions (shard, block, blob) or their postings (block, blob).

    A block is named by its contents, so a second pass that cut blocks elsewhere
    would find no answers and fail rather than score wrongly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, BLOCK):
            buf, off = textkit.utf8(batch.column("text"))
            held = batch.column("held").to_numpy(zero_copy_only=False)
            seed = int(textkit.mix(np.array([len(buf) + 1], np.uint64))[0])
            whole = textkit.step(textkit.slices(buf, off[:-1], off[1:]), np.asarray(batch.column("doc_id").fill_null(-1)).astype(np.uint64))
            name = int(np.array([xxhash.xxh3_64_intdigest(whole.tobytes(), seed)], np.uint64).astype(np.int64)[0])
            block = Block(buf, off, held, shards)
            if what == "questions":
                for shard, blob in block.questions():
                    yield one(shard, name, blob, None)
            else:
                yield one(-1, name, block.postings(), batch.select(["doc_id", "held"]).to_pylist())

    def one(shard: int, name: int, blob: bytes, rows: list | None) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.struct([("doc_id", pa.int64()), ("held", pa.bool_())])))
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((shard, name, blob, rows), kinds, strict=True)], ["shard", "block", "blob", "rows"])

    return docs.mapInArrow(run, "shard int, block bigint, blob binary, rows array<struct<doc_id:bigint,held:boolean>>")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of equal keys of sorted batches, one key after another."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def shard_answers(asked: DataFrame) -> DataFrame:
    """(shard, block, blob, n, v): the replies; n and v are a shard's share of N and V, on one row of it."""
    dealt = asked.drop("rows").repartition("shard").sortWithinPartitions("shard", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "shard"):
            with tempfile.TemporaryDirectory() as folder:  # of this task; it goes with the task
                replies, n, v = answers([r["blob"] for r in rows], folder)
            k = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["shard"] for r in rows], pa.int32()),
                    pa.array([r["block"] for r in rows], pa.int64()),
                    pa.array(replies, pa.binary()),
                    pa.array([n] + [0] * (k - 1), pa.int64()),
                    pa.array([v] + [0] * (k - 1), pa.int64()),
                ],
                ["shard", "block", "blob", "n", "v"],
            )

    return dealt.mapInArrow(run, "shard int, block bigint, blob binary, n bigint, v bigint")


def score_texts(docs: DataFrame, held: Column, mu: float = MU) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; rows where `held` is false train the model."""
    spark = docs.sparkSession
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held"))
    replies = materialise(shard_answers(blocks(base, shards, "questions")), "lm-answers")
    total = replies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    started = docs.filter(~held).count()
    n, v = int(total["n"]), int(total["v"])
    asked = blocks(base, shards, "postings")
    met = asked.unionByName(replies.select("shard", "block", "blob", F.lit(None).cast(asked.schema["rows"].dataType).alias("rows")))
    dealt = met.repartition("block").sortWithinPartitions("block", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "block"):
            own = [r for r in rows if r["shard"] < 0]
            got = {r["shard"]: r["blob"] for r in rows if r["shard"] >= 0}  # blocks of equal contents have equal answers
            for r in own:
                tokens, known, plain, model = score_block(r["blob"], list(got.values()), n, v, started, mu)
                k = len(r["rows"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["doc_id"] for x in r["rows"]], pa.int64()),
                        pa.array([x["held"] for x in r["rows"]], pa.bool_()),
                        pa.array(tokens.astype(np.int64)),
                        pa.array(known.astype(np.int64)),
                        pa.array([n] * k, pa.int64()),
                        pa.array(plain),
                        pa.array(model),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return dealt.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def digest(docs: DataFrame) -> DataFrame:
    return score_texts(docs, held_out())
