"""Queries without SQL against plain Python on small rows."""

import difflib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import texts
from quillspark.operators import changes, guards, recommend, scans
from tests.test_rules import paragraphs, revision


def edits(n=60):
    """Paragraphs and edits that replace, drop and add words."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "ing", "olt", "une", "est")]
    for _ in range(n):
        before = rng.choices(words, k=rng.randint(5, 60))
        after = []
        for w in before:
            roll = rng.random()
            after += [] if roll < 0.05 else [rng.choice(words)] if roll < 0.12 else [w, rng.choice(words)] if roll < 0.16 else [w]
        yield " ".join(before) + ".", " ".join(after) + "."


def opcodes(a, b):
    left, right = re.findall(r"\S+\s*", a), re.findall(r"\S+\s*", b)
    return [(t, "".join(left[i:j]), "".join(right[k:m])) for t, i, j, k, m in difflib.SequenceMatcher(None, left, right).get_opcodes()]


def test_change_counts(spark):
    pairs = [p for p in edits() if p[0] != p[1]]
    row = changes.change_counts(revision(spark, *pairs)).first()
    ops = Counter(t for a, b in pairs for t, *_ in opcodes(a, b))
    assert (row.paragraphs, row.insertions, row.deletions) == (len(pairs), ops["insert"] + ops["replace"], ops["delete"] + ops["replace"])


def test_recurring_changes(spark):
    pairs = list(edits(200))
    fold = lambda x: x[:1].lower() + x[1:]
    n = Counter()
    for a, b in pairs:
        for t, old, new in opcodes(a, b):
            old, new = old.strip(), new.strip()
            if t == "replace" and 2 <= len(old) <= 60 and 2 <= len(new) <= 60 and fold(old) != fold(new):
                n[fold(old), fold(new)] += 1
    want = sorted((k for k in n.values() if k >= 3), reverse=True)[:12]
    got = changes.recurring_changes(revision(spark, *pairs)).orderBy("rank").collect()
    assert [r.n for r in got] == want and all(n[fold(r.old), fold(r.new)] == r.n for r in got) and want


def test_chunk_edits(spark):
    pairs = list(edits(23))
    got = {(r.chunk, r.k): (r.idx, [(s.op, s.old, s.new) for s in r.spans]) for r in changes.chunk_edits(revision(spark, *pairs)).collect()}
    want = {}
    names = {"equal": "same", "delete": "del", "insert": "ins", "replace": "replace"}
    for c in range(0, 23, 5):
        for k, i in enumerate([i for i in range(c, min(23, c + 5)) if pairs[i][0] != pairs[i][1]][:4], 1):
            want[c // 5, k] = (i, [(names[t], a, b) for t, a, b in opcodes(*pairs[i])])
    assert got == want


@pytest.mark.parametrize(
    ("before", "after", "lost"),
    [
        (["recovery (G_IC,healed/G_IC,pristine) to identify"], ["recovery (GIC,healed/GIC,pristine) to identify"], ["G_IC,healed", "G_IC,pristine"]),
        (["the value of G_IC,healed here"] * 6, ["the value of GIC,healed here"] * 6, ["G_IC,healed"]),
        (["an impact above 1J at 150 °C"], ["an impact above 1 J at 150°C"], []),
        (["the H2O and SiO2 content"], ["the H₂O and SiO₂ content"], []),
        (["an R^2 of 0.98"], ["an R² of 0.98"], []),
        (["an R^2 of 0.98"], ["an R2 of 0.98"], ["R^2"]),
    ],
)
def test_token_census(spark, before, after, lost):
    assert sorted(r.token for r in guards.missing_tokens(revision(spark, *zip(before, after, strict=True))).collect()) == lost


def prose(seed, n=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice("alpha beta gamma delta nor seems found often".split()) for _ in range(rng.randint(3, 60))).capitalize() + rng.choice(".!?") for _ in range(n)]


def split(text):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if 10 <= len(s.split()) <= 45]


def test_sentences(spark):
    rows = [" ".join(prose(i, 6)) for i in range(8)]
    got = {(r.idx, r.sentence) for r in scans.sentences(paragraphs(spark, *rows)).collect()}
    assert got == {(i, s) for i, t in enumerate(rows) for s in split(t)} and got


def test_originality(spark):
    mine, theirs = [" ".join(prose(1, 9)), " ".join(prose(2, 9))], [(i, " ".join(prose(1 + i % 2, 9)[: 3 + i])) for i in range(5)]
    flags = recommend.originality(paragraphs(spark, *mine), spark.createDataFrame(theirs, "source_id bigint, text string"))
    norm = lambda s: re.sub(r"\s+", " ", s.lower()).strip()
    known = {}
    for i, t in theirs:
        for s in re.split(r"(?<=[.!?])\s+", t):
            known.setdefault(norm(s), set()).add(i)
    want = {(k, s): (len(known[norm(s)]), ",".join(map(str, sorted(known[norm(s)])[:3]))) for k, t in enumerate(mine) for s in split(t) if norm(s) in known}
    assert {(r.idx, r.sentence): (r.n_sources, r.sources) for r in flags.collect()} == want and want
    total = sum(len(split(t)) for t in mine)
    row = recommend.originality_score(paragraphs(spark, *mine), flags).first()
    assert (row.checked, row.flagged, row.score) == (total, len(want), round(100 * (1 - len(want) / total)))


def test_even_sample(spark):
    rows = [" ".join(prose(i, 12)) for i in range(12)]
    every = [s for t in rows for s in split(t)]
    got = [r.sentence for r in recommend.sample_sentences(paragraphs(spark, *rows)).orderBy("idx", "place").collect()]
    step = len(every) / 25
    assert got == [every[int(k * step)] for k in range(25)]


REFERENCES = ["References", "[1]. Able AA, Baker BB. Growth of stones in water. J Test Sci. 2019;12(3):45-67.", "[2]. Cole CC. Measures of the northern heat. J Heat. 2020;7(1):1-9.", "[3]. Dunn DD. Mosses under early snow. Moss Lett. 2018;4(4):5-9."]


def test_moved_numbers(spark):
    same = [(x, x) for x in REFERENCES]
    got = guards.moved_numbers(revision(spark, ("Introduction", "Introduction"), ("as shown in [1] and [2].", "as shown in [1] and [3]."), *same)).collect()
    assert [(r.was, r.now) for r in got] == [("[1] [2]", "[1] [3]")]
    moved = [(x, y) for x, y in zip(REFERENCES, [REFERENCES[0], REFERENCES[2], REFERENCES[1], REFERENCES[3]], strict=True)]
    assert guards.moved_numbers(revision(spark, ("as shown in [1] and [2].", "as shown in [1] and [3]."), *moved)).count() == 0


def test_references_lost(spark):
    r = revision(spark, ("Introduction", "Introduction"), *[(x, "" if "Mosses" in x else x.replace("water", "fresh water")) for x in REFERENCES], ("", "[4]. Other OO. Wholly different matters entirely. J New. 2021;1(1):1-2."))
    got = sorted((x.change, x.text[:10]) for x in guards.references_lost(r).collect())
    assert got == [("lost", "[3]. Dunn "), ("surplus", "[4]. Other")]


def test_loss_report(spark):
    r = revision(spark, ("Introduction", "Introduction"), ("see https://a.org/x here", "see here"), ("Figure 2. A thing", "A thing"), *[(x, "" if "Mosses" in x else x) for x in REFERENCES])
    row = guards.loss_report(r).first()
    assert (row.works_lost, row.works_repeated, row.links_lost, row.captions_lost) == (1, 0, 1, 1)


def test_first_use_and_expansions(spark):
    p = "the Automatic Gain Control (AGC) was set"
    r = revision(spark, (p, p), ("then AGC held", "then the Automatic Gain Control (AGC) held"), ("and AGC went", "and Added Gain Control (AGC) went"), ("the OER came", "the Open Educational Resources (OER) came"), ("we saw AGC", "we saw the Added Gain Control (AGC)"))
    assert [(x.idx, x.text) for x in guards.first_use(r).collect()] == [(1, "then the AGC held")]
    got = {x.idx: x.restored for x in guards.invented_expansions(r).collect()}
    assert got == {2: "and AGC went", 3: None, 4: "we saw the AGC"}


def test_propagated_spelling(spark):
    r = revision(spark, ("the centre held", "the center held"), ("a centre again", "a centre again"), ("the word stays", "the sword stays nowhere"), (REFERENCES[1] + " centre", REFERENCES[1] + " centre"))
    assert [(x.idx, x.text) for x in guards.propagate_changes(r).collect()] == [(1, "a center again")]


def test_protected_text_and_numbers(spark):
    r = revision(spark, ("Received: 12 March 2020", "Received: 12 2020"), ("Step 2: if x then y", "if x then y"), ("Figure 3. A thing of note", "A thing of note"), ("as Figure 3 and Table 1 show", "as Figure 3 shows"))
    assert {x.idx: x.restored for x in guards.protected_text(r).collect()} == {0: "Received: 12 March 2020", 1: "Step 2: if x then y", 2: "Figure 3. A thing of note", 3: "as Figure 3 and Table 1 show"}
    entries = revision(spark, *[(x, re.sub(r"^\[\d\]\. ", "", x)) for x in REFERENCES])
    assert {x.idx: x.restored for x in guards.entry_numbers(entries).collect()} == {i: x for i, x in enumerate(REFERENCES) if i}


@pytest.mark.parametrize(("text", "want"), [("1,200 of 3 and 4.5", ["1200", "3", "4.5"]), ("2. In 12 cases", ["12"]), ("x² and H₂O", ["2", "2"]), ("[3]. at 7", ["7"])])
def test_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(texts.numbers(F.col("t"))).first()[0] == want


def test_number_losses(spark):
    df = spark.createDataFrame([("It was 12 in March 5 and 1,200 [cited 2020]", "It was 12")], "a string, b string")
    got = df.select(texts.array_lost(texts.numbers(texts.sanctioned(F.col("a"))), texts.numbers(texts.sanctioned(F.col("b"))))).first()[0]
    assert got == ["1200"]
