"""The near-dedup stage against brute force on sets of 5-word shingles."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import near, simhash, textkit
from tests.llm.test_operators import SCHEMA, corpus


def shingles(text, size=5):
    words = (text or "").encode().translate(bytes(textkit.LOWER.tolist())).split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def near_copies():
    """Texts with copies on both sides of 0.8, chains of them, and two of them within 3 SimHash bits below 0.8."""
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        words = prose(rng.randint(40, 300))
        texts.append(words)
        for changes in (1, 2, 3, 5, 8):
            words = list(words)
            for _ in range(changes):
                words[rng.randrange(len(words))] = "new" + str(rng.randrange(9999))
            texts.append(words)
    return [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]


def kept(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and likeness(sets[a], sets[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted(i for i in sets if root[i] == i)


@pytest.mark.parametrize("chunk", [near.CHUNK, 900])
def test_stage_links_at_eight_tenths(spark, chunk):
    rows = near_copies() + [(1000 + i, t, *rest) for i, t, *rest in corpus()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(r.doc_id for r in near.least_of_components(docs, chunk=chunk).collect())
    assert got == kept(rows) and len(got) < len(rows) - 60
    if chunk == near.CHUNK:
        assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == got


def test_pieces_meet_as_often_as_the_likeness_says():
    rng = np.random.default_rng(3)
    met = total = 0
    for _ in range(150):
        x = rng.integers(0, 1 << near.HASH_BITS, 110, np.uint64)
        a, b = np.sort(x[:100]), np.sort(x[10:])  # 90 of 110
        p = near.pieces(np.concatenate([a, b]), np.array([0, 100, 200]))
        met, total = met + int((p[0] == p[1]).sum()), total + near.BANDS
    assert abs(met / total - (90 / 110) ** near.ROWS) < 0.03


def test_links_are_exact():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(20):
        base = rng.integers(0, 1 << 40, 60, np.uint64)
        sets += [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 40, k, np.uint64)])) for k in (0, 4, 6, 8, 12)]
    a, b = near.linked(sets)
    got = near.Forest(len(sets))
    got.join(a, b)
    want = near.Forest(len(sets))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if likeness(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
    want.join(*np.array(pairs).T)
    every = np.arange(len(sets))
    assert np.array_equal(got.root(every), want.root(every)) and len(a) == len(sets) - len(set(want.root(every).tolist()))


def test_equal_sets_have_equal_marks():
    mark, held = near.entries(*textkit.utf8(pa.array(["a b c d e a b c d e a", "a b c d e a b c d e a b", "A B c d e  a b c d e a", "", None, "x"])))
    assert mark[0] == mark[1] == mark[2] and mark[3] == mark[4] != mark[5] and [len(x) for x in held.to_pylist()] == [40, 40, 40, 0, 0, 40]
