"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become classes, with one character of look-ahead folded in, and a
small automaton over the classes says where pieces start.  A character is a
function from state to state; such functions compose associatively, so blocks of
text are reduced side by side, the block results are scanned, and a second pass
writes the boundaries.  No regular expression runs.

Pieces are slices of the text's bytes.  Each distinct piece of a batch is merged
once, all new ones at a time in numpy, and kept in a bounded cache.  Offsets of
the tokens in the text's bytes are kept for decoding.

Edge cases: null is the empty text, with no tokens; equal texts encode equally;
an empty table gives an empty table; a column named like the output is replaced.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .attach import attach

# Unicode's White_Space property, and the endings of contractions.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, JOINS, ALONE = range(8)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINED, IN_SPACES, TWO_LEFT, ONE_LEFT = range(8)

#: Pieces that a worker keeps, and bytes of text that it encodes at a time: these bound its memory.
CACHED = 150_000
LONGEST_CACHED = 64
TOGETHER = 1 << 20


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[class * 8 + state] and whether a piece starts there; class + 8 is a row's first character."""
    after, starts = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for state in range(8):
        after[LETTER, state] = {TWO_LEFT: ONE_LEFT, ONE_LEFT: FRESH}.get(state, IN_LETTERS)
        starts[LETTER, state] = state not in (IN_LETTERS, JOINED, TWO_LEFT, ONE_LEFT)
        after[NUMBER, state], starts[NUMBER, state] = IN_NUMBERS, state not in (IN_NUMBERS, JOINED)
        inside = state in (IN_OTHER, JOINED)
        after[OTHER, state], starts[OTHER, state] = IN_OTHER, not inside
        after[SHORT, state], starts[SHORT, state] = IN_OTHER if inside else ONE_LEFT, not inside
        after[LONG, state], starts[LONG, state] = IN_OTHER if inside else TWO_LEFT, not inside
        after[SPACES, state], starts[SPACES, state] = IN_SPACES, state != IN_SPACES
        after[JOINS, state], after[ALONE, state] = JOINED, FRESH
    after[8:] = after[:8, :1]
    return after.ravel(), starts.ravel()


NEXT, STARTS = _automaton()


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kinds[c] = LETTER
        elif major == "N":
            kinds[c] = NUMBER
    kinds[list(WHITE_SPACE)] = SPACES
    return kinds


def classes(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The automaton's class of each code point; rows: offsets of the rows."""
    n = len(points)
    kind = code_point_classes()[points]
    last = np.zeros(n + 3, bool)
    last[rows[1:][np.diff(rows) > 0] - 1] = True
    ahead = np.append(points, np.zeros(3, points.dtype))
    space = kind == SPACES
    before_text = space & ~last[:n] & ~np.append(space[1:], False)
    kind[before_text] = np.where(points[before_text] == 0x20, JOINS, ALONE)
    quote = np.flatnonzero((points == 0x27) & ~last[:n])
    for ending in ENDINGS:
        hit = ahead[quote + 1] == ord(ending[0])
        if len(ending) == 2:
            hit &= (ahead[quote + 2] == ord(ending[1])) & ~last[quote + 1]
        kind[quote[hit]] = SHORT if len(ending) == 1 else LONG
    kind[rows[:-1][np.diff(rows) > 0]] += 8
    return kind


def piece_starts(kind: np.ndarray, block: int = 512) -> np.ndarray:
    """Where pieces start, by a blocked scan over the characters' transition functions."""
    n = len(kind)
    if not n:
        return np.zeros(0, bool)
    width = -(-n // block)
    laid = np.full(block * width, 8 + OTHER, np.uint8)
    laid[:n] = kind
    across = np.ascontiguousarray(laid.reshape(width, block).T).astype(np.intp) * 8  # step, block of text
    functions = np.repeat(np.arange(8, dtype=np.uint8)[:, None], width, 1)
    for step in across:
        functions = NEXT[step + functions]
    state = np.zeros(width, np.uint8)
    for i in range(1, width):
        state[i] = functions[state[i - 1], i - 1]
    out = np.empty((block, width), bool)
    for i, step in enumerate(across):
        at = step + state
        out[i] = STARTS[at]
        state = NEXT[at]
    return out.T.ravel()[:n]


class Vocabulary:
    """Ranks of byte strings, and every pair of tokens that merges into a third."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for piece, r in self.rank.items():
            self.token[r] = piece
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        keys, ranks = [], []
        for piece, r in self.rank.items():
            for cut in range(1, len(piece)):
                a, b = self.rank.get(piece[:cut]), self.rank.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.none = np.int64(1 << 40)
        self.sizes = np.array([len(t) for t in self.token], np.int64)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The tokens of each piece: the adjacent pair of least rank, leftmost first, merges until none can."""
        done: list[tuple[int, ...] | None] = [None if (r := self.rank.get(p)) is None else (r,) for p in pieces]
        for i, p in enumerate(pieces):
            if done[i] is None and len(p) > LONGEST_CACHED:
                done[i] = self.merge_long(p)
        todo = [i for i, x in enumerate(done) if x is None]
        if not todo:
            return done
        sizes = np.array([len(pieces[i]) for i in todo])
        ids = self.byte[np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)]
        who = np.repeat(np.array(todo), sizes)
        pair = self._pairs(ids, who)
        while len(ids):
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            least = np.minimum.reduceat(pair, first)
            size = np.diff(np.append(first, len(ids)))
            over = least == self.none
            if over.any():
                for a, n in zip(first[over].tolist(), size[over].tolist(), strict=True):
                    done[int(who[a])] = tuple(ids[a : a + n].tolist())
                keep = ~np.repeat(over, size)
                ids, who, pair = ids[keep], who[keep], pair[keep]
                first, least, size = np.cumsum(size[~over]) - size[~over], least[~over], size[~over]
                if not len(ids):
                    break
            hit = np.flatnonzero(pair == np.repeat(least, size))
            group = who[hit]
            hit = hit[np.append(True, group[1:] != group[:-1])]  # the leftmost of each piece
            ids[hit] = pair[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            now = np.cumsum(keep)[hit] - 1
            ids, who, pair = ids[keep], who[keep], pair[keep]
            pair[now] = self._pair_at(ids, who, now)
            left = now[now > 0] - 1
            pair[left] = self._pair_at(ids, who, left)
        return done

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for one long piece: a heap of pairs, in which those that a merge has outdated are passed over."""
        ids: list[int] = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:]))
        known = np.flatnonzero(first != self.none)
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in known.tolist()]
        heapq.heapify(heap)
        ranks = self.merged
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < len(ids):
                before[k] = i
                if (r := ranks.get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return tuple(x for x in ids if x >= 0)

    @cached_property
    def merged(self) -> dict[tuple[int, int], int]:
        """The rank of each pair that merges."""
        return {(k >> 32, k & 0xFFFFFFFF): r for k, r in zip(self.keys.tolist(), self.ranks.tolist(), strict=True)}

    def _pair_at(self, ids: np.ndarray, who: np.ndarray, at: np.ndarray) -> np.ndarray:
        right = np.minimum(at + 1, len(ids) - 1)
        found = self.pair_ranks(ids[at], ids[right])
        found[(at + 1 >= len(ids)) | (who[at] != who[right])] = self.none
        return found

    def _pairs(self, ids: np.ndarray, who: np.ndarray) -> np.ndarray:
        return self._pair_at(ids, who, np.arange(len(ids)))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def piece_ranges(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pieces start, and of each row the range of its pieces."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    start = lead[piece_starts(classes(points, np.searchsorted(lead, off)))]
    return start, np.searchsorted(start, off)


def distinct_pieces(raw: bytes, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pieces, and which of them each piece is.

    Every piece is compared byte by byte with the first one of equal hash; where
    they differ, it becomes a name of its own.
    """
    size = end - start
    _, at, which = np.unique(textkit.slices(buf, start, end), return_index=True, return_inverse=True)
    a, b = start[at], end[at]
    names = [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    same = textkit.equal_slices(buf, start, size, a[which], (b - a)[which])
    if not same.all():
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():
            piece = raw[start[i] : end[i]]
            if piece not in known:
                known[piece] = len(names)
                names.append(piece)
            which[i] = known[piece]
    return names, which


def encode_batch(vocab: Vocabulary, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All token ids, the byte offset of each in its row, and the range of tokens of each row."""
    start, row = piece_ranges(buf, off)
    end = np.append(start[1:], len(buf)) if len(start) else start
    raw, cache = buf.tobytes(), vocab.cache
    if len(cache) > CACHED:
        cache.clear()
    names, which = distinct_pieces(raw, buf, start, end)
    found = [cache.get(k) for k in names]
    new = [i for i, x in enumerate(found) if x is None]
    for i, tokens in zip(new, vocab.merge([names[i] for i in new]), strict=True):
        found[i] = tokens
        if len(names[i]) <= LONGEST_CACHED:
            cache[names[i]] = tokens
    size = np.array([len(x) for x in found], np.int64)
    flat = np.array([t for x in found for t in x], np.int64)
    base = np.cumsum(size) - size
    n = size[which]
    total = np.append(0, np.cumsum(n))
    ids = flat[np.arange(total[-1]) - np.repeat(total[:-1] - base[which], n)] if len(which) else flat
    tokens = total[row]
    place = np.append(0, np.cumsum(vocab.sizes[ids])) if len(ids) else np.zeros(1, np.int64)
    offsets = place[:-1] - np.repeat(off[:-1], np.diff(tokens))
    return ids, offsets, tokens


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, name: str = "tokens", text: str = "text", path: str | None = None) -> DataFrame:
    """docs with a struct column: `ids` array<int> and `offsets` array<int>, each token's first byte in the text.

    path: the rank file, which every executor can read at that place.
    """
    where = path or default_path()

    def make(buf, off):
        ids, offsets, tokens = encode_batch(vocabulary(where), buf, off)
        at = pa.array(tokens.astype(np.int32))
        return [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (ids, offsets)]

    return attach(docs, name, "struct<ids:array<int>,offsets:array<int>>", make, text, TOGETHER)


def decode(df: DataFrame, ids: str, name: str = "decoded", path: str | None = None) -> DataFrame:
    """df with a binary column of the bytes that the ids stand for; null ids have none."""
    where = path or default_path()
    base = df.drop(name)
    schema = T.StructType([*base.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(where).token.__getitem__
        for batch in batches:
            column = batch.column(ids)
            flat = column.flatten().to_numpy()
            made, at = [], 0
            for n in column.value_lengths().fill_null(0).to_pylist():
                made.append(b"".join(map(token, flat[at : at + n].tolist())))
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, name])

    return base.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    encoded = encode(docs.select("doc_id", "text")).select("doc_id", F.col("tokens.ids").alias("ids"))
    return decode(encoded, "ids").select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document's token ids, and whether they decode to its text again.

    training_part and training_row say where the row stood in the files of the
    stage before, which are in training order; null where docs aren't read from files.
    """
    try:
        place = docs.select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("training_part"), F.col("_metadata.row_index").alias("training_row"), "doc_id", "text", "lang", "source")
    except AnalysisException:
        place = docs.select(F.lit(None).cast("int").alias("training_part"), F.lit(None).cast("bigint").alias("training_row"), "doc_id", "text", "lang", "source")
    encoded = encode(place).withColumn("ids", F.col("tokens.ids")).drop("tokens")
    same = F.sha2("decoded", 256) == F.sha2(F.coalesce("text", F.lit("")), 256)
    return decode(encoded, "ids").select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"), "training_part", "training_row")
