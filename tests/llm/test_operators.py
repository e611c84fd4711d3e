"""The dealt operators against brute force on small tables, edge cases included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from quillspark.llm import bpe, components, fingerprint_index, line_dedup, mixing, ngram_lm, quality, repeats, rules, simhash, sketch, suffix_dedup, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    """Prose of a few hundred words with copies, near copies, shared passages, repeats, empty, null and odd texts."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghéß", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared, base = prose(60), prose(150)
    texts = [
        base, base, base.replace(" ", "  ", 3), base[:400] + "X" + base[401:], prose(30) + "\n" + shared + "\n" + prose(40), shared + " " + prose(20),
        "one\ntwo\nthree\nfour\n" + prose(20), prose(20) + "\none\ntwo\nthree\nfour", "A b. C\x0bd\x1ce f", "", None, " \n\t ", "x " * 200, prose(5) + "\n" + prose(5) + "\n\n" + prose(3), "same\nsame\nsame\nsame", prose(2000),
    ]
    texts += [prose(rng.randint(1, 90)) for _ in range(20)]
    sources = ["a", "b", None, "Z"]
    return [(i * 3, t, "en", sources[i % 4], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def taken(df, *keys):
    return {r[keys[0] if keys else "doc_id"]: r for r in df.collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_mixing_meets_targets(docs, rows):
    got = taken(mixing.digest(docs))
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    assert {i: r["size"] for i, r in got.items()} == size
    source = {i: s for i, _, _, s, _ in rows}
    total, left, weight = sum(size.values()), dict.fromkeys(sorted({s for s in source.values() if s}) + [None]), {}
    for k, s in enumerate(left):
        weight[s] = (5, 2, 1)[k % 3]
    have = {s: sum(n for i, n in size.items() if source[i] == s) for s in left}
    target, open_ = dict.fromkeys(left, 0.0), set(left)
    rest = float(total)
    while open_:
        share = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * have[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 3.0 * have[s] for s in over}
        rest -= sum(3 * have[s] for s in over)
        open_ -= over
    for i, r in got.items():
        assert r["target"] == pytest.approx(target[source[i]]) and r["source_size"] == have[source[i]] and 0 <= r["taken"] <= 3 * size[i]
    for s in left:
        assert sum(r["taken"] for i, r in got.items() if source[i] == s) == math.floor(target[s] + 1e-9)


def test_curriculum_inverts_demand(spark):
    df = spark.createDataFrame([(c, x / 20) for c in range(3) for x in range(21)], "c int, share double")
    for r in df.select("c", "share", mixing.position(F.col("c"), F.col("share")).alias("t")).collect():
        (a, u), (_, v) = mixing.SCHEDULES[r.c]
        assert u * r.t + (v - u) * r.t**2 / 2 == pytest.approx(r.share, abs=1e-9)


def test_lm_scores(docs, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower)), b" end"] for i, t, *_ in rows}
    one, two, starts = Counter(), Counter(), 0
    for i, w in tokens.items():
        if not held(i):
            one.update(w)
            two.update(zip([b" start", *w[:-1]], w, strict=True))
            starts += 1
    n, v = sum(one.values()), len(one)
    got = taken(ngram_lm.digest(docs))
    assert set(got) == set(tokens)
    for i, w in tokens.items():
        p = lambda x: (one[x] + 1) / (n + v + 1)
        score = sum(math.log10((two[(a, b)] + ngram_lm.MU * p(b)) / ((starts if a == b" start" else one[a]) + ngram_lm.MU)) for a, b in zip([b" start", *w[:-1]], w, strict=True))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(one[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10(p(x)) for x in w)) and r.score == pytest.approx(score, rel=1e-3)


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (100, 120), (5000, 1 << 50)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = ngram_lm.EliasFano(values, str(tmp_path), f"x{n}")
        assert np.array_equal(ef.access(np.arange(n)), values)
        asked = np.concatenate([values, rng.integers(0, top, 50).astype(np.uint64)])
        zero = np.zeros(len(asked), np.int64)
        assert np.array_equal(ef.successor(zero, zero + n, asked), np.searchsorted(values, asked))


def test_quality_on_held_out_rows(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(80)]
    rows = [(i, " ".join(w.upper() + "!!" if i % 3 == 0 else w for w in rng.choices(words, k=40)), int(i % 3 != 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, 1), (3, None)], "doc_id bigint, quality int")
    got = taken(quality.digest(docs, labels))
    test = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == rows[i][2] for i in test) / len(test) > 0.95
    assert got[1000].score == got[1001].score and 0 <= got[1000].score <= 1 and all(got[i].held_out for i in test)
    none = taken(quality.digest(docs, labels.filter("false")))
    assert {r.score for r in none.values()} == {0.5}


def brute(parts, size):
    count = Counter(p[i : i + size] for p in parts.values() for i in range(len(p) - size + 1))
    out = {}
    for d, p in parts.items():
        gone = [False] * len(p)
        for i in range(len(p) - size + 1):
            if count[p[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        out[d] = gone
    return out


def test_substring_dedup(docs, rows):
    words = {i: tuple(WORD.findall(t or "")) for i, t, *_ in rows}
    got = taken(fingerprint_index.digest(docs))
    for i, gone in brute(words, 35).items():
        kept = " ".join(w for w, g in zip(words[i], gone, strict=True) if not g).encode()
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(gone), sum(gone), sha(kept))
    assert sum(r.n_removed > 0 for r in got.values()) > 5


def test_index_is_incremental(spark, docs):
    found = repeats.anchors(repeats.keyed(docs), repeats.WORDS)
    index = fingerprint_index.FingerprintIndex(spark)
    for b in range(3):
        index.append(found.filter(F.pmod("mark", F.lit(3)) == b))
    before = {tuple(r) for r in index.counts().collect()}
    index.compact()
    assert len(index.runs) == 1 and {tuple(r) for r in index.counts().collect()} == before


@pytest.mark.parametrize("large", [suffix_dedup.LARGE, 1])
def test_suffix_dedup(docs, rows, large):
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    base = repeats.keyed(docs)
    ranges = suffix_dedup.repeated_ranges(base, repeats.anchors(base, repeats.BYTES, suffix_dedup.SIDE), large=large)
    got = taken(repeats.removed(base, ranges, suffix_dedup.clean, suffix_dedup.FIELDS), "doc")
    again = brute(raw, 256)
    for i, gone in brute(raw, 400).items():
        kept = bytes(b for b, g in zip(raw[i], gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept), r.n_repeated) == (len(gone), sum(gone), spans, sha(kept), kept, sum(again[i]))
    assert any(r.n_repeated > r.n_removed for r in got.values())


def test_bpe_equals_the_library(docs, rows):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    vocab = bpe.vocabulary(bpe.default_path())
    reference = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=vocab.rank, special_tokens={})
    odd = ["'s 'll don't ''s  's\n's I'M", "  a  b \n\n c", "x\t", "１２3 ٣a", "中文 ß!?…", "a b", "<|endoftext|>", "'", "it's'll"]
    texts = odd + [t or "" for _, t, *_ in rows]
    ids, offsets, at = bpe.encode_batch(vocab, *textkit.utf8(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == reference.encode_ordinary(t)
    got = taken(bpe.digest(docs))
    for i, t, *_ in rows:
        want = reference.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), sha(" ".join(map(str, want)).encode()), sha((t or "").encode()))


def simple_rules(text):
    words = WORD.findall(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        again += bool(WORD.search(line)) and line in seen
        seen.add(line)
    gone = brute({0: tuple(words)}, 8)[0]
    failed = len(words) < 20 or 100 * sum(gone) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in rules.SYMBOLS for c in text), again, sum(gone), failed


def test_quality_rules(docs, rows):
    got = taken(rules.digest(docs))
    pack = zstandard.ZstdCompressor(level=rules.LEVEL).compress
    for i, t, *_ in rows:
        r, raw = got[i], (t or "").encode()
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == simple_rules(t or "")
        assert not (r.base_failed and r.kept) and (not raw or r.ratio == pytest.approx(len(pack(raw)) / len(raw)))


def test_sketches(docs, rows):
    got = taken(sketch.digest(docs))
    order = sorted(rows)
    for k, (i, t, *_) in enumerate(order):
        after, t = order[(k + 1) % len(order)][1] or "", t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha(edited.encode())
        shingles = lambda x: {tuple(w[j : j + 5]) for w in [WORD.findall(x.lower())] for j in range(max(1, len(w) - 4)) if w}
        for other, near in ((edited, got[i].near_edited), (after, got[i].near_next)):
            a, b = shingles(t), shingles(other)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.12)
    assert got[0].fingerprint == got[3].fingerprint


def test_sketches_merge():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 48, 3000).astype(np.uint64)) for _ in range(2))
    both = np.union1d(a, b)
    k = sketch.K
    assert np.array_equal(np.union1d(a[:k], b[:k])[:k], both[:k])
    assert sketch.distinct_estimate(both[:k]) == pytest.approx(len(both), rel=0.25)
    assert sketch.containment(a[:k], both[:k]) == pytest.approx(1.0, abs=0.2)


def simple_lines(rows, words=5, run=3):
    """Later repeats of windows (as many lines as have 5 words, 3 at most), with up to 2 equal lines beside them and the first window."""
    first, gone = {}, {}
    texts = {i: [] if t is None else t.split("\n") for i, t, *_ in rows}
    worded = {i: [k for k, x in enumerate(lines) if WORD.search(x)] for i, lines in texts.items()}
    line = lambda i, a: texts[i][worded[i][a]] if 0 <= a < len(worded[i]) else None
    for i in sorted(texts):
        gone[i] = set()
        for a in range(len(worded[i])):
            k = next((k for k in range(1, run) if sum(len(WORD.findall(line(i, a + j) or "")) for j in range(k)) >= words), run)
            if a + k > len(worded[i]):
                continue
            key = tuple(line(i, a + j) for j in range(k))
            if key in first:
                d, b = first[key]
                left = next((j for j in range(run - 1) if line(i, a - j - 1) is None or line(i, a - j - 1) != line(d, b - j - 1)), run - 1)
                right = next((j for j in range(run - 1) if line(i, a + k + j) is None or line(i, a + k + j) != line(d, b + k + j)), run - 1)
                gone[i] |= {worded[i][x] for x in range(a - left, a + k + right)}
            first.setdefault(key, (i, a))
    return gone


def test_line_dedup(docs, rows):
    got, gone = taken(line_dedup.digest(docs)), simple_lines(rows)
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone[i])
        assert (got[i].n_lines, got[i].n_removed, got[i].kept_md5) == (len(lines), len(gone[i]), hashlib.md5(kept.encode()).hexdigest())
    assert sum(bool(g) for g in gone.values()) >= 2


def simple_simhash(text, size=3):
    words = text.encode().translate(bytes(textkit.LOWER.tolist())).split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def simple_components(bits):
    root = {i: i for i in bits}
    for _ in bits:
        for a in bits:
            for b in bits:
                if (bits[a] ^ bits[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_simhash(docs, rows):
    bits = {i: simple_simhash(t or "") for i, t, *_ in rows}
    root, got = simple_components(bits), taken(simhash.digest(docs))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{b:016x}", root[i]) for i, b in bits.items()}


def test_every_three_positions_leave_one_list():
    for gone in combinations(range(8), 3):
        assert sum(not set(gone) & set(c) for c in simhash.FIXED) == 1


def test_long_posting_lists(monkeypatch):
    rng = np.random.default_rng(4)
    free = sorted(set(range(8)) - set(simhash.FIXED[0]))
    low = rng.integers(0, 1 << 14, 700).astype(np.uint64)
    members = np.unique((low & np.uint64(0xFF)) << np.uint64(8 * free[0]) | (low >> np.uint64(8)) << np.uint64(8 * free[1]) | np.uint64(0xAB << 8 * simhash.FIXED[0][0]))
    want = simhash.forest(members, simhash.FIXED[0])
    monkeypatch.setattr(simhash, "_PAIRWISE", 10)
    got = simhash.forest(members, simhash.FIXED[0])
    groups = lambda links: (lambda f: f.root(np.arange(len(members))))(_joined(members, links))
    assert np.array_equal(groups(want), groups(got))
    every = components.Forest(len(members))
    every.join(*np.nonzero(np.bitwise_count(members[:, None] ^ members[None, :]) <= 3))
    assert np.array_equal(groups(want), every.root(np.arange(len(members))))


def _joined(members, links):
    tree = components.Forest(len(members))
    tree.join(np.searchsorted(members, links[0]), np.searchsorted(members, links[1]))
    return tree


def test_components(spark):
    edges = [(5, 3), (3, 9), (9, 1), (20, 21), (7, 7), (21, 20)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[x] for x in (1, 3, 5, 9)} == {1} and got[21] == 20 and {got[100 + k] for k in range(41)} == {100} and 7 not in got
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


EMPTY = [mixing.digest, ngram_lm.digest, fingerprint_index.digest, suffix_dedup.digest, bpe.digest, rules.digest, sketch.digest, line_dedup.digest, simhash.digest]


@pytest.mark.parametrize("digest", EMPTY, ids=lambda f: f.__module__.split(".")[-1])
def test_empty_tables(docs, digest):
    assert digest(docs.filter("false")).count() == 0


@pytest.mark.parametrize("digest", EMPTY, ids=lambda f: f.__module__.split(".")[-1])
def test_nulls_repeated_rows_and_clashing_columns(spark, digest):
    rows = [(1, "a b c d e " * 30), (1, "a b c d e " * 30), (None, "q"), (2, None), (3, "")]
    df = spark.createDataFrame([(i, t, None, None, None, "x", "y", "z") for i, t in rows], SCHEMA + ", rules string, size string, bits string")
    got = [tuple(r) for r in digest(df).collect()]
    assert len(got) == (5 if digest is not simhash.digest else 5)
