"""The pipeline's stages against brute force, each on its own input."""

import pytest

import corpus_pipeline
from quillspark.llm import bpe, mixing, rules
from tests.llm.test_near import kept
from tests.llm.test_operators import SCHEMA, corpus, simple_lines


@pytest.fixture(scope="module")
def rows():
    clean = corpus()
    return [r for r in clean if r[1]] + [(900, clean[0][1], "en", "a", 5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "byte_bpe"]


def test_quality_stage(spark, docs):
    kept = {r.doc_id for r in rules.digest(docs).filter("kept").collect()}
    got = corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == kept and 0 < len(kept) < docs.count()


def test_line_stage(spark, docs, rows):
    gone = simple_lines(rows)
    got = corpus_pipeline.STAGES[1][1](spark, docs, "")
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t, *_ in rows}
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == want
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_near_stage(spark, docs, rows):
    got = corpus_pipeline.STAGES[2][1](spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_mixing_stage(spark, docs):
    plan = {r.doc_id: round(r.taken / r["size"] + 1e-9) if r["size"] else 0 for r in mixing.digest(docs).collect()}
    got = corpus_pipeline.STAGES[3][1](spark, docs, "")
    count = {}
    for r in got.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert got.columns == docs.columns and all(abs(count.get(i, 0) - n) <= 1 for i, n in plan.items())


def test_bpe_stage(spark, docs, rows):
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[4][1](spark, docs, "").collect()}
    vocab = bpe.vocabulary(bpe.default_path())
    for i, t, *_ in rows:
        assert got[i].round_trip and got[i].n_tokens == len(got[i].ids) and b"".join(vocab.token[x] for x in got[i].ids) == t.encode()


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.filter("NOT round_trip").count() == 0


def test_stages_take_empty_tables(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), "").count() == 0
