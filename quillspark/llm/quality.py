"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs and
character n-grams, followed by a softmax over the two labels.  Training is
stochastic gradient descent in numpy, with step sizes that shrink by each
vector's own past gradients, on a bounded sample of labelled rows (MAX_ROWS and
MAX_BYTES, parameters); it runs in one task.  Since the output is linear in the average, the
model collapses to one number for each bucket, so scoring needs a look-up for
each feature and no vectors; this table has a fixed size, and only it is sent
to the scoring tasks.

Features come from the whole text and nothing else.  A repeat feature says how
far back (in powers of two) the same word stood before.

Edge cases: null is the empty text, which scores the softmax of the bias alone;
labels that are null, or of unknown documents, teach nothing; several labels of
a document are averaged; without two classes among the rows the score is the
share of label 1 (one half without any row); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit
from .attach import attach

BUCKETS = 1 << 17
DIMENSIONS = 16
GRAMS = (3, 4)
MAX_ROWS = 3000
MAX_BYTES = 64 << 20
EPOCHS = 6
BATCH = 32
RATE = 0.1
FOLDS = 5
THRESHOLD = 0.3
SEED = 7


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all features, and the row of each; ids of a kind are in text order."""
    words = textkit.Words(buf, off)
    n, rows = words.counts(), len(off) - 1
    hashes = words.hashes()
    row = np.repeat(np.arange(rows), n)
    ids, who = [hashes], [row]
    pair = textkit.windows(words.row, 2) if len(words) else np.zeros(0, np.int64)
    ids.append(textkit.runs(hashes, 2)[pair] if len(pair) else np.zeros(0, np.uint64))
    who.append(row[pair])
    # how far back the same word stood in the row
    key = textkit.mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    gap = (order[1:] - order[:-1])[same]
    ids.append(textkit.mix(np.log2(np.minimum(gap, 4096)).astype(np.uint64) + np.uint64(0x51ED270B)))
    who.append(row[order[1:]][same])
    # character n-grams inside words, a word's edges shown by a space
    spaced = np.full(len(buf) + 2 * len(words), 0x20, np.uint8)
    size = words.end - words.start
    start = np.cumsum(size + 2) - size - 2
    inside = np.repeat(start + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    spaced = spaced[: int((size + 2).sum())]
    spaced[inside] = buf[~textkit.IS_SPACE[buf]]
    value = spaced.astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size + 2)
    for g in GRAMS:
        code = np.zeros(max(0, len(value) - g + 1), np.uint64)
        for i in range(g):
            code = code << np.uint64(8) | value[i : i + len(code)]
        whole = np.flatnonzero(word[: len(code)] == word[g - 1 :]) if len(code) else np.zeros(0, np.int64)
        ids.append(textkit.mix(code[whole] + np.uint64(g << 40)))
        who.append(row[word[whole]])
    return (np.concatenate(ids) & np.uint64(BUCKETS - 1)).astype(np.int32), np.concatenate(who)


def train(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """One weight for each bucket and the bias: the log-odds of label 1 are the mean weight plus the bias."""
    ones = float(labels.sum())
    if not 0 < ones < len(labels):
        share = ones / len(labels) if len(labels) else 0.5
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    bags = []
    for batch in textkit.pieces(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
        ids, who = features(*textkit.utf8(batch.column(0)))
        key, count = np.unique(who.astype(np.int64) << 32 | ids, return_counts=True)
        at = np.searchsorted(key, np.arange(batch.num_rows + 1, dtype=np.int64) << 32)
        for a, b in zip(at[:-1], at[1:], strict=True):
            bags.append(((key[a:b] & 0xFFFFFFFF).astype(np.int32), (count[a:b] / max(1, count[a:b].sum())).astype(np.float32)))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    out = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.log(np.array([len(labels) - ones, ones]) / len(labels)).astype(np.float32)
    past_v, past_o, past_b = np.full(BUCKETS, 1e-8, np.float32), np.full_like(out, 1e-6), np.full(2, 1e-2, np.float32)
    y = np.eye(2, dtype=np.float32)[labels.astype(int)]
    full = np.array([i for i, x in enumerate(bags) if len(x[0])])
    for _ in range(epochs):
        order = rng.permutation(full)
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            ids = np.concatenate([bags[j][0] for j in chosen])
            weight = np.concatenate([bags[j][1] for j in chosen])
            sizes = np.array([len(bags[j][0]) for j in chosen])
            hidden = np.add.reduceat(vectors[ids] * weight[:, None], np.cumsum(sizes) - sizes)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - y[chosen]) / len(chosen)
            back = np.repeat(error @ out.T, sizes, 0) * weight[:, None]
            unique, place = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(place, back[:, d], len(unique)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            past_v[unique] += (grad**2).mean(1)
            vectors[unique] -= rate * grad / np.sqrt(past_v[unique])[:, None]
            grad = hidden.T @ error
            past_o += grad**2
            out -= rate * grad / np.sqrt(past_o)
            grad = error.sum(0)
            past_b += grad**2
            bias -= rate * grad / np.sqrt(past_b)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Trains on at most max_rows labelled documents, those of least hash of the id, and of these on MAX_BYTES of text."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # at most max_rows ids are broadcast
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over at most max_rows numbers
    size = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n"))
    within = size.withColumn("sum", F.sum("n").over(order)).filter(F.col("sum") <= MAX_BYTES).select("doc_id")
    one = rows.join(F.broadcast(within), "doc_id").repartition(1).sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        texts = pa.chunked_array([b.column("text") for b in held], pa.string()).combine_chunks() if held else pa.array([], pa.string())
        y = np.concatenate([np.zeros(0), *[np.asarray(b.column("label")) for b in held]]) >= 0.5
        weights, bias = train(texts, y)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], ["weights", "bias"])

    made = one.select("text", "label").mapInArrow(run, "weights binary, bias double").first()
    if made is None:  # no labelled row
        return train(pa.array([], pa.string()), np.zeros(0))
    return np.frombuffer(made["weights"], np.float32), made["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "quality", text: str = "text") -> DataFrame:
    """docs with a struct column whose field `score` is the probability of label 1."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]  # BUCKETS numbers

    def make(buf, off):
        ids, who = features(buf, off)
        rows = len(off) - 1
        count = np.bincount(who, minlength=rows)
        total = np.bincount(who, weights.value[ids], rows)
        return [1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias)))]

    return attach(docs, name, "struct<score:double>", make, text)


def held_out(doc_id: str = "doc_id", folds: int = FOLDS):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.select("doc_id", "quality").filter(~held_out()))
    scored = score(docs.select("doc_id", "text"), model).select("doc_id", F.col("quality.score").alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
