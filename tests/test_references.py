"""Bibliography joins and gaps against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import references

WORDS = [f"{a}{b}" for a in ("stone", "water", "heat", "moss", "river", "lamp") for b in ("", "work", "land", "fall", "born")]


def words(text):
    return set(re.findall("[a-z]{4,}", text.lower()))


def squeezed(text):
    return re.sub("[^a-z0-9]", "", text.lower())


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    common = ["study", "with", "some"]  # words that nearly every title has
    works = [(f"d{i:03d}", " ".join(rng.sample(WORDS, rng.randint(1, 7)) + common[: rng.randint(0, 3)]).capitalize(), rng.choice(["", "", "review"])) for i in range(150)]
    works += [("d900", "", ""), ("d901", "an of it", ""), ("d902", "Study with some", "")]
    refs = []
    for i in range(120):
        title = rng.choice(works)[1].split()
        rng.shuffle(title) if i % 3 == 0 else None
        text = " ".join(["[1]. Able AA.", *title[: len(title) - rng.randint(0, 2)], *rng.sample(WORDS, rng.randint(0, 3)), "in a", rng.choice(["journal.", "review."]), "2019."])
        refs.append((i % 7, i, text + (" https://doi.org/10.1000/a1" if i % 11 == 0 else "")))
    return refs, works


def test_every_pair_over_the_share_is_a_candidate(spark, tables):
    refs, works = tables
    df = spark.createDataFrame(refs, "doc_id int, ref_no int, text string"), spark.createDataFrame(works, "doi string, title string, type string")
    for share in (55, 80, 100):
        got = {(r.ref_no, r.doi) for r in references.title_candidates(*df, share).collect()}
        want = {(n, d) for _, n, t in refs for d, title, _ in works if (w := words(title)) and 100 * len(w & words(t)) >= share * len(w)}
        assert want <= got and len(got) < len(refs) * len(works) * 0.5


def test_filled_dois(spark, tables):
    refs, works = tables
    want = {}
    for doc, n, t in refs:
        fit = []
        for d, title, kind in works:
            w = words(title)
            score = round(100 * len(w & words(t)) / len(w), 6) if w else 0
            if score > 55 and (squeezed(title) in squeezed(t) or score >= 85) and not ("review" in kind and "review" not in t.lower()):
                fit.append((-score, d))
        if fit and "10.1000" not in t:
            want[doc, n] = (min(fit)[1], -min(fit)[0], "works")
    second = [(f"s{i}", t) for i, (_, t, _) in enumerate(works) if i % 2] + [("long", squeezed(refs[1][2])[:60] + " and much more")]
    for doc, n, t in refs:
        if (doc, n) not in want and "10.1000" not in t:
            c = squeezed(t)
            heads = [d for d, title in second if len(s := squeezed(title)) >= 12 and (s[:30] in c or c[:30] in s)]
            if heads:
                want[doc, n] = (min(heads), None, "secondary")
    got = references.fill_dois(spark.createDataFrame(refs, "doc_id int, ref_no int, text string"), spark.createDataFrame(works, "doi string, title string, type string"), spark.createDataFrame(second, "doi string, title string"))
    assert {(r.doc_id, r.ref_no): (r.doi, r.score, r.source) for r in got.collect()} == want
    assert {s for *_, s in want.values()} == {"works", "secondary"}


@pytest.mark.parametrize(
    ("text", "title", "chapter"),
    [
        ("Unesco.org. 2026. Available from: https://example.org/long/address", True, False),
        ("Mikro TA, Iatraki G. Digital technology for all learners. Educ Inf Technol. 2023; 28(4): 3911–3935p.", False, False),
        ("In: Smith AB, editor. Handbook of quiet things. Leiden: Press; 2020.", False, True),
        ("In: Smith AB, editor. Handbook of quiet things. Leiden: Press; 2020. p. 10-25.", False, False),
        ("Smith AB. Two words. 2020.", False, False),
        ("Smith A. 2020.", True, False),
        ("2020", True, False),
        ("", True, False),
    ],
)
def test_gaps(spark, text, title, chapter):
    row = spark.createDataFrame([(text,)], "t string").select(references.lacks_title(F.col("t")), references.lacks_chapter_pages(F.col("t"))).first()
    assert tuple(row) == (title, chapter)


def test_article_tables(spark):
    one = ["", "1. Of mosses", "Ann Able1*, Bob Baker2 and Cy Cole", "Moss Institute, Leiden", "Abstract", "So it is [1].", "", "Key words: moss; stone, Heat.", "1 First Part", "As [1, 3–9] and [0007] say [12345678901234567890].", "2.1 Second Part", "Figure 3. What was seen [2]", "Table 2 shows it", "Tab. 4: Of heat", "Keywords: other", "References", "[1] Moss A. One. 2001.", "and more", "[2] Moss A. Two. 2002.", "", "3. Three and More"]
    two = ["Title", "Ann Able", "Moss University", "Text [1]", "Bibliography", "Moss A. One. 2001."]
    three = ["Title", "Two Words", "Text [1]"]
    p = spark.createDataFrame([(d, i, t) for d, texts in enumerate((one, two, three)) for i, t in enumerate(texts)], "doc_id int, idx int, text string")
    got = {(r.doc_id, r.idx): r for r in references.article_tables(p).collect()}
    assert len(got) == p.count()
    kinds = lambda d: [r.kind for (e, _), r in sorted(got.items()) if e == d]
    assert kinds(0) == ["text", "title", "byline", "affiliation", "heading", "abstract", "text", "keywords", "heading", "text", "heading", "caption", "text", "caption", "text", "heading", "reference", "reference", "reference", "reference", "reference"]
    assert kinds(1) == ["title", "byline", "affiliation", "text", "heading", "reference"] and kinds(2) == ["title", "text", "text"]
    assert got[0, 2]["items"] == ["Ann Able", "Bob Baker", "Cy Cole"] and got[0, 7]["items"] == ["moss", "stone", "Heat"]
    assert [(got[0, i].label, got[0, i].depth, got[0, i].content) for i in (4, 8, 10, 11, 13)] == [(None, 1, "Abstract"), ("1", 1, "First Part"), ("2.1", 2, "Second Part"), ("Figure 3", None, "What was seen [2]"), ("Tab. 4", None, "Of heat")]
    assert (got[0, 9].section, got[0, 9].heading, got[0, 13].heading, got[0, 0].section) == (2, "1 First Part", "2.1 Second Part", 0)
    assert got[0, 9].xrefs == [1, 3] and got[0, 11].xrefs == [2] and got[0, 5].xrefs is None and got[1, 3].xrefs == [1] and got[2, 2].xrefs == []
