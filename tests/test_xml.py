"""Values of XML by patterns: what XPath says in every form, and no XPath where the form is plain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillspark.sources import packages, xml

PARAGRAPHS = (
    '<p><pPr><keepNext/><jc val="left"/></pPr><r><t>x</t></r></p>',
    "<p><pPr><jc val='single'/></pPr></p>",
    '<p><pPr><jc/><jc val="second"/></pPr></p>',
    '<p><pPr><jc val="a &amp; b"/></pPr></p>',
    '<p><pPr><rPr><jc val="not mine"/></rPr></pPr></p>',
    '<p><pPr><rPr><b/></rPr><jc val="behind"/></pPr></p>',
    '<p><pPr/><pPr><jc val="later"/></pPr></p>',
    '<p><pPr><jc other="x>y" val="z"/></pPr></p>',
    '<p><!-- <jc val="no"/> --><pPr><jc val=""/></pPr></p>',
    '<p rsid="1"> <pPr> <jc b="1" val="spaced" /></pPr></p>',
    "<p><r><t>jc</t></r></p>",
)
RUNS = (
    '<r><rPr><b/><sz val="20"/></rPr><t xml="a">one</t><br/><t>two</t><t/></r>',
    "<r><t>a &lt;b&gt; &amp;amp; &quot;c&apos; &#13;</t></r>",
    "<r><t>&#233;</t></r>",
    "<r><t><![CDATA[<t>x</t>]]></t></r>",
    "<r><t>a<!-- b -->c</t></r>",
    "<r><pict><t>inner</t></pict><t>own</t></r>",
    "<r><t>a\r\nb</t></r>",
    '<r><t a="x>y">z</t></r>',
    "<r><tab/><t/></r>",
)
CHANGES = (
    "<p><del><r><delText>was</delText></r></del><ins><r><t>now</t></r></ins><r><t>both</t></r></p>",
    '<p><pPr><rPr><ins id="1"/></rPr></pPr><ins id="2"><r><t>a</t></r></ins><r><t>b</t></r></p>',
    "<p><ins><r><t>a</t></r><ins><r><t>b</t></r></ins><r><t>c</t></r></ins><r><t>d</t></r></p>",
    "<p><ins a='1'><r><t>a</t></r></ins><del><r><t>odd</t><delText>b</delText></r></del></p>",
)


def both(spark, pieces, mine, theirs):
    frame = spark.createDataFrame([(x,) for x in pieces], "x string")
    return [tuple(r) for r in frame.select(mine(F.col("x")).alias("a"), theirs(F.col("x")).alias("b")).collect()]


def test_values_are_those_of_xpath(spark):
    cases = [(PARAGRAPHS, lambda x: xml.attribute(x, "/p/pPr/jc/@val"), lambda x: F.nullif(F.xpath_string(x, F.lit("/p/pPr/jc/@val")), F.lit("")))]
    cases += [(RUNS, lambda x: xml.has(x, "/r/rPr/b"), lambda x: F.size(F.xpath(x, F.lit("/r/rPr/b"))) > 0)]
    cases += [(RUNS, xml.run_text, lambda x: F.array_join(F.xpath(x, F.lit("/r/t/text()")), "")), (RUNS, lambda x: xml.text_of(x, "t"), lambda x: F.array_join(F.xpath(x, F.lit("//t/text()")), ""))]
    cases += [(CHANGES, lambda x: xml.text_of(x, "t", "delText", outside="ins"), lambda x: F.array_join(F.xpath(x, F.lit("//t[not(ancestor::ins)]/text() | //delText[not(ancestor::ins)]/text()")), ""))]
    cases += [(CHANGES, lambda x: xml.text_of(x, "t", outside="del"), lambda x: F.array_join(F.xpath(x, F.lit("//t[not(ancestor::del)]/text()")), ""))]
    for pieces, mine, theirs in cases:
        for piece, (a, b) in zip(pieces, both(spark, pieces, mine, theirs), strict=True):
            assert a == b, piece


def test_plain_values_are_not_parsed(spark):
    """XPath refuses what is cut."""
    for piece, value, want in (('<p><pPr><b/><jc val="left"/>', lambda x: xml.attribute(x, "/p/pPr/jc/@val"), "left"), ("<p><pPr>", lambda x: xml.attribute(x, "/p/pPr/jc/@val"), None), ("<p><r><t>a</t>", lambda x: xml.text_of(x, "t"), "a")):
        assert spark.createDataFrame([(piece,)], "x string").select(value(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("name", ("package_headings", "package_table_format", "package_styles", "package_outline", "package_cells"))
def test_packages_are_opened_once(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def test_results_leave_tasks_in_pieces():
    frames = list(packages.in_pieces(((str(k), "x" * packages.PIECE) for k in range(3)), ["path", "xml"]))
    assert [len(f) for f in frames] == [1, 1, 1] and list(packages.in_pieces([], ["path"])) == []
