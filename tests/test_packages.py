"""Package parts: picture headers, style chains, nested tables, list levels and printed numbers, table specification."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import tables as table_rules
from quillspark.sources import packages, styles
from quillspark.sources.pictures import header

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\x08\x02\0\0\0"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xff\xdb\x00\x03\0\xff\xc2\x00\x11\x08" + struct.pack(">HH", 30, 70) + b"\x03"


def test_headers_of_pictures():
    assert header(PNG) == ("PNG", 640, 480)
    assert header(JPEG) == ("JPEG", 70, 30)
    assert header(b"GIF89a" + struct.pack("<HH", 5, 6)) == ("GIF", 5, 6)
    assert header(b"BM" + b"\0" * 16 + struct.pack("<ii", 8, -9)) == ("BMP", 8, 9)
    for n in range(len(PNG[:24])):
        assert header(PNG[:n]) is None
    for n in range(len(JPEG) - 1):
        assert header(JPEG[:n]) is None
    assert header(b"") is None and header(b"\xff\xd8\0\0\0\0") is None and header(b"<svg/>") is None


def package(tmp_path, body, **parts):
    with zipfile.ZipFile(tmp_path / "a1.docx", "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>')
        for name, data in parts.items():
            z.writestr({"styles": "word/styles.xml", "numbering": "word/numbering.xml", "rels": "word/_rels/document.xml.rels"}.get(name, f"word/media/{name}.png"), data)
    return str(tmp_path)


def p(text, inside=""):
    return f"<w:p>{inside}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_nested_tables_and_text_boxes(spark, tmp_path):
    inner = f"<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}<w:p/></w:tc></w:tr><w:tr><w:tc>{p('z')}</w:tc></w:tr></w:tbl>"
    deep = f"<w:tbl><w:tr><w:tc>{inner}{p('d')}</w:tc></w:tr></w:tbl>"
    box = "<w:p><w:r><w:t>seen</w:t></w:r><w:r><w:pict><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></w:pict></w:r></w:p>"
    body = p("one") + f"<w:tbl><w:tr><w:tc>{p('a')}{deep}{p('b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr></w:tbl>" + box + f"<w:tbl><w:tr><w:tc>{p('last')}</w:tc></w:tr></w:tbl>" + p("end")
    t = packages.ingest_packages(spark, package(tmp_path, body))
    assert [r.text for r in t["paragraphs"].orderBy("idx").collect()] == ["one", "seen", "end"]
    got = {(r.table_no, r.depth, r.row, r.col): r.text for r in t["cells"].collect()}
    assert got == {(0, 1, 0, 0): "a\nb", (0, 1, 0, 1): "c", (1, 2, 0, 0): "d", (2, 3, 0, 0): "x", (2, 3, 0, 1): "y", (2, 3, 1, 0): "z", (3, 1, 0, 0): "last"}
    assert {(r.table_no, r.after_idx) for r in t["tables"].collect()} == {(0, 0), (1, 0), (2, 0), (3, 1)}


def test_styles_are_inherited(spark, tmp_path):
    style = lambda i, parent, inside="", more="": f'<w:style w:type="paragraph" w:styleId="{i}"{more}><w:name w:val="{i}"/>' + (f'<w:basedOn w:val="{parent}"/>' if parent else "") + f"{inside}</w:style>"
    chain = "".join(style(f"S{k}", f"S{k - 1}") for k in range(1, 12)) + style("S0", None, '<w:rPr><w:rFonts w:ascii="Deep"/></w:rPr>')
    loops = style("A", "B", '<w:rPr><w:sz w:val="21"/></w:rPr>') + style("B", "A")
    sheet = f'<w:styles {W}>{style("Normal", None, more=" w:default=" + chr(34) + "1" + chr(34))}{chain}{loops}{style("Heading 3", None)}{style("H", "Heading 3")}</w:styles>'
    names = ["S0", "S7", "S8", "A", "B", "H", "gone", None]
    body = "".join(p(str(n), f'<w:pPr><w:pStyle w:val="{n}"/></w:pPr>' if n else "") for n in names)
    t = packages.ingest_packages(spark, package(tmp_path, body, styles=sheet))
    runs = {r.text: (r.font_name, r.font_size_pt) for r in t["runs"].collect()}
    assert runs == {"S0": ("Deep", None), "S7": ("Deep", None), "S8": (None, None), "A": (None, 10.5), "B": (None, 10.5), "H": (None, None), "gone": (None, None), "None": (None, None)}
    formats = {r.idx: (r.style, r.outline_level) for r in t["para_format"].collect()}
    assert formats[5] == ("H", 2) and formats[6] == ("Normal", None) and formats[7] == ("Normal", None)


def test_lists_without_definition(spark, tmp_path):
    body = p("a", '<w:pPr><w:numPr><w:ilvl w:val="4"/><w:numId w:val="9"/></w:numPr></w:pPr>') + p("b")
    t = packages.ingest_packages(spark, package(tmp_path, body))
    got = [r.listing for r in t["para_format"].orderBy("idx").collect()]
    assert (got[0].kind, got[0].num_id, got[0].level, got[0].house_code) == ("unknown", "9", 4, None) and got[1] is None


def outline(levels):
    """Counters by definition: a paragraph counts up its level and clears the deeper ones."""
    counts, out = [0] * 9, []
    for k in levels:
        counts = [*counts[:k], counts[k] + 1, *[0] * (8 - k)]
        out.append(".".join(str(max(1, n)) for n in counts[: k + 1]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_outline_counters(spark, seed):
    import random

    rng = random.Random(seed)
    levels = [rng.randrange(5) for _ in range(80)]
    rows = [(1, i, ("n", k, "number", ".".join(f"%{j + 1}" for j in range(k + 1)))) for i, k in enumerate(levels)]
    formats = spark.createDataFrame(rows, "doc_id int, idx int, listing struct<num_id:string,level:int,kind:string,lvl_text:string>")
    known = spark.createDataFrame([(1, "n", k, 1, "decimal", "") for k in range(9)], "doc_id int, num_id string, level int, start int, num_fmt string, lvl_text string")
    got = styles.outline_numbers(formats, known).orderBy("idx").collect()
    assert [r.label for r in got] == outline(levels)


def test_printed_numbers(spark):
    rows = [(n, f) for n in (1, 4, 9, 26, 27, 52, 53, 1994) for f in ("decimal", "lowerRoman", "upperLetter", "decimalZero", "chicago")]
    got = {(r.n, r.f): r.x for r in spark.createDataFrame(rows, "n int, f string").select("n", "f", styles.printed(F.col("n"), F.col("f")).alias("x")).collect()}
    assert [got[n, "lowerRoman"] for n in (1, 4, 9, 1994)] == ["i", "iv", "ix", "mcmxciv"] and [got[n, "upperLetter"] for n in (1, 26, 27, 53)] == ["A", "Z", "AA", "AAA"]
    assert got[9, "decimalZero"] == "09" and got[27, "chicago"] == "27"


def test_specification_prefers_its_own_scope(spark):
    rows = [(1, 0, "caption", "size", 9.0, None), (1, 0, "cell", "size", 9.0, None), (1, 0, "cell", "size", 11.0, None), (1, 0, "cell", "bold", 0.0, None), (1, 0, "head", "bold", 0.0, None), (1, 0, "head", "bold", None, None), (1, 0, "any", "border_style", None, None), (1, 0, "any", "margin_top_in", 0.024, None)]
    got = table_rules.table_format(spark.createDataFrame(rows, "doc_id int, table_no int, scope string, attribute string, number double, word string")).collect()
    assert {(r.rule, r.attribute, r.severity, r.n, r.found) for r in got} == {("table.caption-size", "size", "warning", 1, "9.000"), ("table.size", "size", "warning", 1, "11.000"), ("table.column-head", "bold", "warning", 1, "0.000"), ("table.border", "border_style", "info", 1, "not stated")}
