"""Rules on hand-written rows, positive and negative."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import predicates as P
from quillspark.functions import rewrites as R
from quillspark.operators import changes, consistency, findings, guards, recommend, references, scans, usage


def paragraphs(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id bigint, idx int, text string")


def revision(spark, *pairs):
    return spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(pairs)], "doc_id bigint, idx int, original string, edited string")


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    ("rewrite", "before", "after"),
    [
        (R.cap_authors, "1. Able AA, Baker BB, Cole CC, Dunn DD, Ells EE, Ford FF, Gray GG. Title. J.", "1. Able AA, Baker BB, Cole CC, Dunn DD, Ells EE, Ford FF, et al. Title. J."),
        (R.cap_authors, "1. Able AA, Baker BB. Title. J.", "1. Able AA, Baker BB. Title. J."),
        (R.year_only, "1. Able AA. Title. J. 15 Mar 2020;1:2.", "1. Able AA. Title. J. 2020;1:2."),
        (R.year_only, "In July 2025 we ran the trial.", "In July 2025 we ran the trial."),
        (R.drop_paren_cite, "grew (Brown, 2018) [7] fast", "grew [7] fast"),
        (R.drop_paren_cite, "as Brown (2018) says [7]", "as Brown (2018) says [7]"),
        (R.keywords_line, "Keywords: zeta; alpha, Beta", "Keywords: Alpha, Beta, zeta"),
        (R.keywords_line, "Keywords: mRNA, pH", "Keywords: mRNA, pH"),
        (R.element_brackets, "see [Figures 8 and 9] and [12]", "see (Figures 8 and 9) and [12]"),
        (R.temperature, "at 550 ° C", "at 550°C"),
        (R.formula_subs, "FeCl3 in D8", "FeCl₃ in D8"),
        (R.unit_case, "5 KJ but 4.2 Nm", "5 kJ but 4.2 Nm"),
        (R.trailing_cite, "It was reached. [17]", "It was reached [17]."),
        (R.citation_punct, "as [1,2] and [3-7]", "as [1, 2] and [3–7]"),
        (R.element_labels, "Fig. 3 shows", "Figure 3 shows"),
        (R.language_variant, "Behavior of the center", "Behaviour of the centre"),
    ],
)
def test_rewrite(spark, rewrite, before, after):
    assert one(spark, rewrite, before) == after


def test_mask_keeps_places(spark):
    text = "see https://a.org/x, or me@b.org now"
    masked = one(spark, R.mask_opaque, text)
    assert len(masked) == len(text) and "https" not in masked and masked.endswith(" now")


@pytest.mark.parametrize(("token", "good"), [("FeCl3", True), ("H2SO4", True), ("M4", False), ("B12", False), ("O2", True), ("SSW1", False), ("I2C", False), ("Bacon", False), ("OV2640", False)])
def test_formula(spark, token, good):
    assert one(spark, P.is_formula, token) is good


def test_orcid(spark):
    assert one(spark, P.orcid_ok, "0000-0002-1825-0097") is True
    assert one(spark, P.orcid_ok, "0000-0002-1825-0098") is False


def test_ranges_and_units(spark):
    p = paragraphs(spark, "call +91-8816867362", "pages 55-65 here", "in the 1970s and 12kg", "2583-8903")
    assert [(r.idx, r.suggestion) for r in scans.hyphen_ranges(p).collect()] == [(1, "55–65")]
    assert [(r.idx, r.suggestion) for r in scans.unit_spacing(p).collect()] == [(2, "12 kg")]


def test_lists_need_no_opening_bracket(spark):
    p = paragraphs(spark, "a) one; b) two", "(Figure 1) is fine", "an (open one", "a stray] one")
    assert sorted(r.idx for r in scans.unbalanced_brackets(p).collect()) == [2, 3]


def test_acronyms(spark):
    p = paragraphs(spark, "Title", "the OER came", "open educational resources (OER) help", "again open educational resources (OER)")
    assert {r.rule for r in consistency.acronyms(p).collect()} == {"acronym.used_before_definition", "acronym.defined_twice"}


def test_losses(spark):
    long = "word " * 40
    r = revision(spark, ("text", " "), ("it was not so", "it was so"), (long, "word " * 10), ("same", "same"))
    assert {(x.idx, x.kind) for x in guards.losses(r).collect()} == {(0, "emptied"), (1, "negation-lost"), (2, "truncated")}


def test_missing_tokens(spark):
    r = revision(spark, ("an R^2 of 0.98", "an R2 of 0.98"), ("1 J at 150 °C", "1 J at 150°C"))
    assert [x.token for x in guards.missing_tokens(r).collect()] == ["R^2"]


def test_recurring_changes(spark):
    r = revision(spark, *[(f"see Fig. {i} here", f"see Figure {i} here") for i in range(6)])
    row = changes.recurring_changes(r).collect()
    assert [(x.old, x.new, x.n) for x in row] == [("Fig.", "Figure", 6)]
    assert changes.recurring_changes(revision(spark, ("a Fig. 1", "a Figure 1"), ("a Fig. 2", "a Figure 2"))).count() == 0


def test_salvage(spark):
    before = "The comparision of breaking system between the disc and drum brakes was made in this long paragraph of text, and it shows the way things are done here."
    after = "The comparison of braking system between the disc."
    assert changes.salvage(revision(spark, (before, after))).first().text == before.replace("comparision", "comparison").replace("breaking", "braking")


def test_domains(spark):
    t = spark.createDataFrame([("Chemical Engineering",), ("Analytical Chemistry",)], "topic string")
    assert {r.topic: r.domain for r in recommend.topic_domain(t).collect()} == {"Chemical Engineering": "engineering", "Analytical Chemistry": "chemistry"}


def test_quota_order(spark):
    users = spark.createDataFrame([(1, "member", 1000, 0), (2, "member", None, None), (3, "admin", 1, 1)], "id bigint, role string, monthly_token_cap bigint, monthly_job_cap bigint")
    used = spark.createDataFrame([(1, "2024-01", 9, 1100), (2, "2024-01", 3, 10), (3, "2024-01", 9, 9999)], "user_id bigint, month string, jobs bigint, total_tokens bigint")
    got = {r.user_id: (r.allowed, r.reason) for r in usage.quota(users, used, "2024-01").collect()}
    assert got == {1: (False, "tokens"), 2: (False, "jobs"), 3: (True, None)}


def test_wrapped_entries(spark):
    lines = spark.createDataFrame([(1, 9, "1. Able AA. A title that"), (1, 10, "wraps. J. 2019;1(2):3-4."), (1, 11, "2. Baker BB. T. J. 2018;1:2."), (1, 12, "3. Cole CC. T. J. 2017;1:2.")], "doc_id bigint, idx int, text string")
    got = {r.ref_no: r.text for r in references.group_entries(lines).collect()}
    assert len(got) == 3 and got[1] == "1. Able AA. A title that wraps. J. 2019;1(2):3-4."


def test_collapse_keeps_three_places(spark):
    f = spark.createDataFrame([(1, i, "space.double", "warning", f"f{i}", None) for i in range(8)], "doc_id bigint, idx int, rule string, severity string, fragment string, suggestion string")
    assert sorted(r.n for r in findings.collapse_repeats(f).collect()) == [1, 1, 1, 5]


def test_guards_change_nothing_twice(spark):
    r = revision(spark, ("see https://a.org here", "see here"), ("an R^2 of 1", "an R2 of 1"), ("fine", "fine"))
    once = guards.restored(r)
    assert once.exceptAll(guards.restored(once)).count() == 0


def test_empty_tables(spark):
    p, r = paragraphs(spark, "x").filter("false"), revision(spark, ("a", "b")).filter("false")
    assert scans.mechanical(p).count() == 0 and guards.run_guards(r).count() == 0 and consistency.cross_references(p).count() == 0
