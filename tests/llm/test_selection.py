"""Resampling, phrase collocations and packing against brute force, odd input included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import collocations, line_dedup, packing, resample
from tests.llm.test_operators import SCHEMA, corpus, simple_lines, taken

CLASHING = "row part place before fit n f k size slot shard least slots words grp ids n_words bucket rank score phrase".split()
LOW = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def rows():
    """The shared corpus, null ids and languages, repeated rows, and a text of 60,000 words without a line end."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeé7", k=rng.randint(1, 4))) for _ in range(90)]
    more = [(200 + i, " ".join(rng.choices(words, k=rng.randint(1, 300))) + rng.choice(["", ".\nEnd. A b c d", "\n\n"]), rng.choice(["en", "fr", None]), "a", 1) for i in range(60)]
    long = " ".join(rng.choices(words, k=60_000))
    return corpus() + more + [(None, "a b, c d e", None, None, None), (None, "a b, c d e", None, None, None), (500, long, "en", "a", 1), (500, long, "en", "a", 1), (501, "x" * 200_000, "fr", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], SCHEMA + "".join(f", {c} string" for c in CLASHING)).repartition(3)


def features(text, order):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize(("order", "buckets"), [(1, 10_000), (3, 997)])
def test_resampling(spark, docs, rows, order, buckets):
    target = [("the end. a b c d\nA b c d e",), (rows[0][1],), (None,), ("",)]
    all_s, all_t = Counter(), Counter()
    for text, into in [(r[1], all_s) for r in rows] + [(t, all_t) for (t,) in target]:
        into.update(x % buckets for x in features(text, order)[1])
    s, t = sum(all_s.values()), sum(all_t.values())
    gain = lambda b: math.floor(1000 * math.log((all_t[b] + 1) * (s + buckets) / ((all_s[b] + 1) * (t + buckets))))
    want, fit = [], []
    for i, text, *_ in rows:
        n, found = features(text, order)
        weight = sum(gain(x % buckets) for x in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append([i, len(found), weight, score, None])
        if n >= 20:
            fit.append(want[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: 10 * len(fit) // 100]):
        r[4] = k + 1
    got = resample.resample(docs, spark.createDataFrame(target, "text string"), order, buckets)
    assert sorted(map(repr, map(tuple, want))) == sorted(repr(tuple(r)) for r in got.collect())


def test_equal_lines_are_counted_once(spark, monkeypatch):
    """A line that stands in a thousand documents reaches the counting task as one row."""
    docs = spark.createDataFrame([("same words here\nthis too",)] * 1000, "text string")
    counts = resample.segment_counts(docs, 2)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("HashAggregate(keys=[text") and "functions=[partial_count" in plan
    assert sum(r.n for r in counts.collect()) == 1000 * (5 + 4)


def test_resampling_of_nothing(spark, docs):
    none = docs.filter("false")
    assert resample.digest(none, none.select("text")).count() == 0
    got = resample.digest(docs, none.select("text")).collect()
    assert len(got) == docs.count() and sum(r.rank is not None for r in got) > 0


def simple_phrases(rows, support, longest, cover, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q, p=p: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(inside(q) and 100 * b >= cover * a for q, b in found.items()):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("support", "longest", "top", "shards"), [(30, 4, 2000, 8), (12, 3, 25, 3), (9, 4, 400, 1)])
def test_collocations(docs, rows, support, longest, top, shards, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50_000)
    monkeypatch.setattr(collocations, "SLOT", 20_000)
    rows = [r for r in rows if len(r[1] or "") < 100_000] + [r for r in rows if len(r[1] or "") >= 100_000]
    got = collocations.collocations(docs, support, longest, 80, top, shards)
    want = simple_phrases(rows, support, longest, 80, top)
    assert want and sorted(map(tuple, got.collect())) == want


def test_shards_mine_at_their_share(spark, docs, rows):
    """Every frequent phrase is a candidate of a shard, at the shard's own support."""
    texts = collocations.prepared(docs, 4)
    shared = collocations.shares(texts, 30, 4)
    for r in shared.collect():
        assert r.least == -(-30 * r.n_words // r.total)
    keys = {r.key for r in collocations.locally_frequent(collocations.runs_of_shards(texts, shared)).collect()}
    phrases, _ = collocations.frequent_phrases(docs, shards=4)
    found = phrases.collect()
    for r in found:
        one = collocations.Phrases(np.frombuffer(r.phrase.encode(), np.uint8), np.array([0, len(r.phrase.encode())]), np.array([r.lang], object), 4)
        assert int(one.key[one.size == r.size][0] >> np.uint64(16)) in keys
    assert len(keys) < 40 * len(found)


def test_collocations_of_nothing(docs):
    assert collocations.digest(docs.filter("false")).count() == 0
    assert collocations.digest(docs.filter("doc_id = 9999 OR text = ''")).count() == 0


def test_large_products_are_exact(spark):
    big = 40_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 1)], "lang string, phrase string, size int, f bigint")
    assert collocations.scored(phrases).first().score == 2_000_000 * big // (2 * big + 8)


def test_packing(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(packing.default_path())
    library.encode_special_tokens = True
    want = Counter()
    for i, text, *_ in rows:
        want[i, np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += 1
    pieces = packing.pack(docs, group_docs=40).collect()
    by = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0
        by[p.sequence_id].append(p)
    size = {}
    for k, own in by.items():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        size[k] = sum(p.length for p in own)
    assert max(size.values()) <= 1024
    padding = sum(1024 - n for n in size.values() if n & (n - 1))
    assert padding <= 0.01 * sum(size.values())
    # rows equal in id and text share their pieces; together they cover their ids as often as they stand
    cover = defaultdict(Counter)
    for p in pieces:
        cover[p.doc_id, p.doc_tokens].update({x: 1 for x in range(p.start, p.start + p.length)})
        assert any(i == p.doc_id and ids[4 * p.start : 4 * (p.start + p.length)] == bytes(p.ids) and len(ids) == 4 * p.doc_tokens for i, ids in want)
    for (i, ids), times in want.items():
        same = sum(t for (j, x), t in want.items() if j == i and len(x) == len(ids))
        assert cover[i, len(ids) // 4] == Counter({x: same for x in range(len(ids) // 4)}) and times
    for p in packing.digest(docs).collect():
        whole = [ids for i, ids in want if i == p.doc_id and len(ids) == 4 * p.doc_tokens]
        assert any(zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for ids in whole)


def test_packed_sequences(docs):
    pieces = packing.pack(docs, length=64)
    got = packing.sequences(pieces, 64, pad=7).collect()
    own = defaultdict(list)
    for p in pieces.collect():
        own[p.sequence_id].append((p.offset, bytes(p.ids)))
    for r in got:
        ids = b"".join(x for _, x in sorted(own[r.sequence_id]))
        assert bytes(r.ids) == ids + (7).to_bytes(4, "little") * r.n_padding and (len(r.ids) == 256 or len(ids) // 4 in (1, 2, 4, 8, 16, 32) and not r.n_padding)
    assert len(got) == len(own)


def test_tournament_tree_is_first_fit_decreasing():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 300):
        sizes = rng.integers(1, 101, n)
        room, want = [], np.zeros(n, np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            at = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [100] * (at == len(room))
            room[at] -= sizes[i]
            want[i] = at
        assert np.array_equal(packing.first_fit_decreasing(sizes, 100), want)


def test_packing_of_nothing(docs):
    assert packing.digest(docs.filter("false")).count() == 0


def test_line_dedup_of_200_000_lines(spark):
    text = lambda seed, n: "\n".join(" ".join(f"{r.choice('abcdefgh')}{r.randrange(50)}" for _ in range(r.randint(1, 6))) for r in [random.Random(seed)] for _ in range(n))
    texts = [text(1, 200_000), text(2, 100_000) + "\n" + text(1, 100_000), "x\ny"]
    got = taken(line_dedup.digest(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)))
    gone = simple_lines([(i, t) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert (got[i].n_removed, got[i].kept_md5) == (len(gone[i]), hashlib.md5(kept.encode()).hexdigest())
    assert len(gone[1]) >= 99_000
