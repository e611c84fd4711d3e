"""Odd input for every operator and stage: colliding patterns, very long texts, nulls, repeats, clashing columns, empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import bpe, fingerprint_index, line_dedup, mixing, ngram_lm, quality, rules, simhash, sketch, suffix_dedup, textkit
from tests.llm.test_operators import SCHEMA, WORD, brute, corpus, sha, simple_lines, simple_rules, taken


def thue_morse(n, a="a", b="b"):
    """A string of 2**n letters, and the one with the letters swapped: equal in any polynomial modulo 2**64 from n = 10 on."""
    s = "".join((a, b)[i.bit_count() & 1] for i in range(1 << n))
    return s, s.translate(str.maketrans(a + b, b + a))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def scored(docs):
    return quality.digest(docs, docs.sparkSession.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int"))


DIGESTS = [mixing.digest, ngram_lm.digest, scored, fingerprint_index.digest, suffix_dedup.digest, bpe.digest, rules.digest, sketch.digest, line_dedup.digest, simhash.digest]
NAMES = [f.__name__ if f is scored else f.__module__.split(".")[-1] for f in DIGESTS]


def test_hashes_tell_swapped_patterns_apart():
    for n in (9, 10, 12):
        x, y = (np.frombuffer(s.encode(), np.uint8) for s in thue_morse(n))
        both = np.concatenate([x, y])
        at = np.array([0, len(x)])
        assert len(np.unique(textkit.slices(both, at, at + len(x)))) == 2
        assert textkit.byte_runs(x, 256)[0] != textkit.byte_runs(y, 256)[0]
        words = textkit.mix(np.concatenate([x, y]).astype(np.uint64))
        assert len(set(textkit.runs(words, len(x))[[0, len(x)]].tolist())) == 2


def test_patterns_in_tokens_lines_and_windows(spark):
    x, y = thue_morse(11)
    got = taken(bpe.digest(table(spark, [x, y])))
    assert [got[i].decoded_sha256 for i in (0, 1)] == [sha(x.encode()), sha(y.encode())] and got[0].ids_sha256 != got[1].ids_sha256
    assert taken(rules.digest(table(spark, [f"{x}\n{y}\n{x}"])))[0].n_dup_lines == 1
    rng = random.Random(1)
    same = " ".join(f"w{rng.randrange(99)}" for _ in range(34))
    texts = [f"{same} {x}", f"{same} {y}", f"{same} z", f"q {same} z"]
    words = {i: tuple(t.split()) for i, t in enumerate(texts)}
    got = taken(fingerprint_index.digest(table(spark, texts)))
    assert {i: got[i].n_removed for i in got} == {i: sum(g) for i, g in brute(words, 35).items()} == {0: 0, 1: 0, 2: 35, 3: 35}
    got = taken(suffix_dedup.digest(table(spark, [x, y])))
    want = brute({0: x.encode(), 1: y.encode()}, 400)
    assert {i: got[i].n_removed for i in got} == {i: sum(g) for i, g in want.items()}


def long_texts():
    rng = random.Random(2)
    words = [f"{rng.choice('abcde')}{rng.randrange(3000)}" for _ in range(60_000)]
    prose = " ".join(words)
    lines = "\n".join(" ".join(words[i : i + 9]) for i in range(0, 30_000, 9))
    return ["x" * 300_000, prose, lines, prose[:200_000] + " end", "".join(rng.choices("abcdefgh", k=200_000))]


def test_very_long_texts(spark):
    texts = long_texts()
    docs = table(spark, texts)
    by = {f.__module__.split(".")[-1]: taken(f(docs)) for f in DIGESTS if f is not scored}
    words = {i: tuple(WORD.findall(t)) for i, t in enumerate(texts)}
    assert {i: r["size"] for i, r in by["mixing"].items()} == {i: r.n_tokens - 1 for i, r in by["ngram_lm"].items()} == {i: len(w) for i, w in words.items()}
    assert {i: r.n_removed for i, r in by["fingerprint_index"].items()} == {i: sum(g) for i, g in brute(words, 35).items()}
    found = by["suffix_dedup"]
    assert found[0].n_removed == 300_000 and found[4].n_removed == 0 and found[1].n_removed >= 200_000 - 10
    assert {i: r.decoded_sha256 for i, r in by["bpe"].items()} == {i: sha(t.encode()) for i, t in enumerate(texts)}
    assert {i: r.n_words for i, r in by["rules"].items()} == {i: len(w) for i, w in words.items()} and not by["rules"][0].kept
    assert by["sketch"][3].n_chars == len(texts[3]) and by["line_dedup"][2].n_removed == len(simple_lines([(2, texts[2])])[2])
    assert {r.component_id for r in by["simhash"].values()} <= set(range(5))
    assert taken(scored(docs))[1].score == pytest.approx(taken(scored(docs))[1].score)


def test_long_pieces_merge_like_short_ones():
    vocab = bpe.vocabulary(bpe.default_path())
    rng = random.Random(3)
    for n in (2, 3, 17, 60):
        for piece in ("".join(rng.choices("etaoin", k=n)), "a" * n, "ab" * (n // 2)):
            assert vocab.merge_long(piece.encode()) == vocab.merge([piece.encode()])[0]


@pytest.mark.parametrize("digest", DIGESTS, ids=NAMES)
def test_nulls_repeats_and_clashing_columns_change_nothing(spark, digest):
    rows = [(1, "a b c d e " * 30), (1, "a b c d e " * 30), (None, "q r s t u v"), (None, None), (2, None), (3, ""), (1, "another text of the same id")]
    clashing = "doc mark gone d o p g key places ranges position copies bits rules tokens lines near simhash sketch size taken target held h n w ls ws part extra".split()
    df = spark.createDataFrame([(i, t, None, None, None, *clashing) for i, t in rows], SCHEMA + "".join(f", {c} string" for c in clashing))
    plain = df.select("doc_id", "text", "lang", "source", "n_chars")
    values = lambda frame: sorted(map(repr, digest(frame).collect()))
    got = values(df)
    assert len(got) == len(rows) and got == values(plain)
    assert digest(df.filter("false")).count() == 0


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages_keep_every_column(spark, name, stage):
    clashing = "doc mark gone d o p g key keep __lines position copies rules near row".split()
    rows = [(i, t, *rest, *clashing) for i, t, *rest in corpus()] + [(None, "x y z " * 20, None, None, None, *clashing), (0, corpus()[0][1], "en", "a", 1, *clashing)]
    df = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in clashing))
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    got = stage(spark, df, "")
    assert got.columns == df.columns
    text = lambda frame: sorted(map(repr, frame.select("doc_id", "text").collect()))
    assert text(got) == text(stage(spark, df.select(*plain), ""))
    assert got.select(*clashing).distinct().count() <= 1


def test_pipeline_takes_nulls_and_repeats(spark, tmp_path):
    rng = random.Random(9)
    prose = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(60)) for _ in range(6)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(prose)] + [(0, prose[0], "en", "a", 1), (9, prose[1], None, None, None), (10, None, "en", "a", 0), (None, None, None, None, None), (None, prose[2] + " more", "en", None, 3)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("training_part", "training_row").collect()
    assert {r.doc_id for r in out} <= {0, 1, 2, 3, 4, 5, None} and all(r.round_trip for r in out) and 9 not in {r.doc_id for r in out}
    assert len({(r.training_part, r.training_row) for r in out}) == len(out) > 0


def test_pipeline_equals_its_stages_by_hand(spark):
    """run() against the stages' plain counterparts: what the rules keep, lines, components, copies, and bytes."""
    from tests.llm.test_near import kept

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs.collect()]
    good = {i for i, t, *_ in rows if verdict(t or "")}
    rows = [r for r in rows if r[0] in good]
    gone = simple_lines(rows)
    rows = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), *rest) for i, t, *rest in rows]
    stay = set(kept(rows))
    rows = [r for r in rows if r[0] in stay]
    plan = {r.doc_id: r.copies for r in mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()}
    size = {i: len(WORD.findall(t)) for i, t, *_ in rows}
    want = sorted((c.position, f"={i}", i) for i, cs in plan.items() for c in cs if 2 * c.words >= size[i] > 0)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").orderBy("training_part", "training_row").collect()
    assert [r.doc_id for r in out] == [i for *_, i in want]
    token = bpe.vocabulary(bpe.default_path()).token
    text = {i: t for i, t, *_ in rows}
    assert all(b"".join(token[x] for x in r.ids) == text[r.doc_id].encode() for r in out)


def verdict(text):
    """The rules' verdict from their definition."""
    pack = zstandard.ZstdCompressor(level=rules.LEVEL).compress
    raw = text.encode()
    if simple_rules(text)[5]:
        return False
    ratio = len(pack(raw)) / len(raw)
    least, most = [(a, b) for n, a, b in rules.BANDS if len(raw) >= n][-1]
    size = rules.CHUNK
    chunks = [raw[i : i + size] for i in range(0, len(raw) - size + 1, size)] if len(raw) > size else []
    if chunks and len(raw) % size:
        chunks.append(raw[-size:])
    odd = [not rules.CHUNK_LOW <= len(pack(c)) / size <= rules.CHUNK_HIGH for c in chunks]
    return least <= ratio <= most and sum(odd) <= rules.ODD_CHUNKS * len(odd) and not any(all(odd[i : i + rules.ODD_RUN]) for i in range(len(odd) - rules.ODD_RUN + 1))


def test_verdicts_of_quality_rules(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshr", weights=range(9, 0, -1), k=rng.randint(2, 6))) for _ in range(n))
    noise = lambda n: " ".join("".join(rng.choices([chr(c) for c in range(33, 1000)], k=10)) for _ in range(n))
    texts = [prose(30), prose(3000), prose(2000) + " " + noise(900), noise(300), prose(1500) + noise(250) + prose(1500), "tick tock boom " * 3 + prose(20), prose(300)]
    texts += [t or "" for _, t, *_ in corpus()]
    got = taken(rules.digest(table(spark, texts)))
    assert {i: r.kept for i, r in got.items()} == {i: verdict(t) for i, t in enumerate(texts)}
    assert not got[2].kept and not got[3].kept and got[1].kept


def test_fingerprint_strings(spark):
    texts = [t or "" for _, t, *_ in corpus()]
    got = taken(sketch.digest(table(spark, texts)))
    for i, t in enumerate(texts):
        words = t.encode().translate(bytes(textkit.LOWER.tolist())).split()
        shingles = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        assert len(got[i].fingerprint) == 12 * min(len(shingles), sketch.K)
        h = [got[i].fingerprint[k : k + 12] for k in range(0, len(got[i].fingerprint), 12)]
        assert h == sorted(set(h))
    for i in range(len(texts)):
        for j in range(i):
            assert (got[i].fingerprint == got[j].fingerprint) == (set(map(tuple, _five(texts[i]))) == set(map(tuple, _five(texts[j]))))


def _five(text):
    words = text.encode().translate(bytes(textkit.LOWER.tolist())).split()
    return [words[k : k + 5] for k in range(max(1, len(words) - 4))] if words else []


def test_merged_sketches_are_those_of_the_union(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    parts = [" ".join(rng.choices(words, k=rng.randint(3, 900))) for _ in range(12)]
    df = table(spark, parts).withColumn("g", F.col("doc_id") % 3)
    merged = sketch.merge(sketch.fingerprint(df).select("g", "sketch.hashes"), ["g"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    got = {r.g: r.hashes for r in merged.collect()}
    for g in range(3):
        each = sketch.sketches(*textkit.utf8(pa.array(parts[g::3])), k=10**9)
        assert got[g] == np.unique(np.concatenate(each))[: sketch.K].astype(np.int64).tolist()
    assert "WindowGroupLimit" in plan  # the least k of a task leave it, not all


def test_classifier_bounds_its_text(spark, monkeypatch):
    docs = table(spark, ["good words here " * 20, "BAD WORDS !! " * 20] * 20)
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(40)], "doc_id bigint, quality int")
    monkeypatch.setattr(quality, "MAX_BYTES", 3000)
    got = taken(quality.digest(docs, labels))
    assert np.mean([got[i].score for i in range(0, 40, 2)]) > np.mean([got[i].score for i in range(1, 40, 2)])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got) and hashlib.sha256(b"").hexdigest() == sha(b"")
