"""Quality rules: text statistics and zstandard compression bands.

Repetitive text compresses far below, and random or encoded text stays far
above, what prose of the same length does.  Each length band has its limits for
the ratio of compressed to raw bytes.  In the documents at hand, texts labelled
good lie between 0.57 and 0.88 below 200 bytes and between 0.41 and 0.44 above
12,800; the limits leave about a quarter of the ratio on either side.  Every
chunk of a fixed size, the last bytes included, is held to limits of its own: a
long document goes if ODD_RUN chunks in a row are odd, or over a share
ODD_CHUNKS of all.

Edge cases: a null or empty text has no words and fails the base rules; equal
rows get equal verdicts; an empty table gives an empty table; a column named
like the output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .attach import attach
from .storage import fresh

# Symbols that mark markup and noise.
SYMBOLS = "#*$%&|<>"

#: (bytes from, least ratio, greatest ratio): limits for whole documents by length.
BANDS = ((0, 0.40, 1.20), (200, 0.40, 0.95), (400, 0.36, 0.85), (800, 0.33, 0.76), (1600, 0.31, 0.68), (3200, 0.29, 0.63), (6400, 0.28, 0.60), (12800, 0.27, 0.58))
#: A chunk's bytes, and its limits.
CHUNK, CHUNK_LOW, CHUNK_HIGH = 4096, 0.25, 0.65
LEVEL = 3
#: The share of odd chunks that a document may have, and how many in a row reject it.
ODD_CHUNKS, ODD_RUN = 0.2, 2

FIELDS = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,ratio:double,low_chunks:bigint,high_chunks:bigint,kept:boolean>"
)


def duplicates(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def per_row(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that are equal only within a row."""
    return textkit.mix(keys + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def repeated_words(words: textkit.Words, size: int) -> np.ndarray:
    """For each row, the words in windows of `size` words that its text has twice or more."""
    starts = textkit.windows(words.row, size) if len(words) else np.zeros(0, np.int64)
    row = np.searchsorted(words.row, starts, "right") - 1
    keys = per_row(textkit.runs(words.hashes(), size)[starts], row) if len(starts) else np.zeros(0, np.uint64)
    twice = starts[duplicates(keys)] if len(keys) else starts
    return textkit.segment_sums(textkit.covered(twice, twice + size, len(words)), words.row)


def duplicate_lines(words: textkit.Words) -> np.ndarray:
    """For each row, the lines with a word that equal an earlier line of the row."""
    buf, off = words.buf, words.off
    rows = len(off) - 1
    breaks = np.flatnonzero(buf == 10)
    row = np.concatenate([np.arange(rows), np.searchsorted(off, breaks, "right") - 1])
    start = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    last = np.append(row[1:] != row[:-1], True)
    end = np.where(last, off[row + 1], np.append(start[1:] - 1, 0))
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, row = start[full], end[full], row[full]
    first = np.unique(per_row(textkit.slices(buf, start, end), row), return_index=True)[1]
    return np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)


def ratios(buf: np.ndarray, off: np.ndarray, bands=BANDS) -> tuple[list, list, list, list]:
    """Whole-document ratio, chunks below and above their limits, and the verdict."""
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    raw = buf.tobytes()
    whole, low, high, good = [], [], [], []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        n = b - a
        ratio = len(pack(raw[a:b])) / n if n else 1.0
        starts = [*range(a, b - CHUNK + 1, CHUNK), *([b - CHUNK] if n % CHUNK else [])] if n > CHUNK else []
        parts = [len(pack(raw[i : i + CHUNK])) / CHUNK for i in starts]
        below, above = sum(x < CHUNK_LOW for x in parts), sum(x > CHUNK_HIGH for x in parts)
        odd = "".join("x" if x < CHUNK_LOW or x > CHUNK_HIGH else "." for x in parts)
        least, most = next((x[1], x[2]) for x in reversed(bands) if n >= x[0])
        whole.append(ratio)
        low.append(below)
        high.append(above)
        good.append(least <= ratio <= most and below + above <= ODD_CHUNKS * len(parts) and "x" * ODD_RUN not in odd)
    return whole, low, high, good


def measure(buf: np.ndarray, off: np.ndarray) -> list:
    words = textkit.Words(buf, off)
    n = words.counts()
    inside = ~textkit.IS_SPACE[buf] & ((buf & 0xC0) != 0x80)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    repeat = repeated_words(words, 8)
    failed = (n < 20) | (100 * repeat > 30 * n)
    whole, low, high, good = ratios(buf, off)
    return [
        n.astype(np.int64),
        textkit.segment_sums(inside, off),
        textkit.segment_sums(symbol[buf], off),
        duplicate_lines(words).astype(np.int64),
        repeat.astype(np.int64),
        failed,
        pa.array(whole, pa.float64()),
        pa.array(low, pa.int64()),
        pa.array(high, pa.int64()),
        ~failed & np.array(good, bool),
    ]


def quality_rules(docs: DataFrame, name: str = "rules", text: str = "text") -> DataFrame:
    """docs with a struct column of statistics and verdicts; `kept` is the verdict."""
    return attach(docs, name, FIELDS, measure, text)


def digest(docs: DataFrame) -> DataFrame:
    return quality_rules(docs.select("doc_id", "text")).select("doc_id", F.col("rules.*")).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    (name,) = fresh(docs.columns, "rules")
    return quality_rules(docs, name).filter(F.col(name)["kept"]).select(*[f"`{c}`" for c in docs.columns])
