"""Registered queries over whole packages: style chains, nested tables, outline numbers, pictures and table specifications.

The documents' manuscripts are written as packages, with style sheets, list
definitions and pictures that follow from their ids and places, and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, scans
from ..operators import tables as table_rules
from ..sources import packages, styles
from . import structure
from .extras import CONTROL, _escaped, clean, packed
from .planting import manuscripts, with_views

#: The styles of document {d}, as (id, name, parent, font, size); the same expressions serve both engines.
SHEET = (
    ("'Base'", "'Normal'", "NULL", "CASE WHEN {d} % 2 = 0 THEN 'Times New Roman' END", "NULL"),
    ("'L1'", "'Text one'", "'Base'", "NULL", "9 + {d} % 4"),
    ("'L2'", "'Text two'", "'L1'", "CASE WHEN {d} % 3 = 0 THEN 'Cambria' END", "NULL"),
    ("'L3'", "'Text three'", "'L2'", "NULL", "CASE WHEN {d} % 5 = 0 THEN 14 END"),
    ("'H2'", "'heading 2'", "'L1'", "NULL", "NULL"),
    ("'Sub'", "'House sub'", "'H2'", "'Arial'", "NULL"),
    ("'Loop'", "'Looped'", "'Loop'", "NULL", "NULL"),
)
DEFAULTS = '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:hAnsi="Calibri"/><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults>'


def _part(name: str, xml: str) -> Column:
    """A member of a package; xml: a SQL expression over doc_id."""
    return F.array(F.struct(F.lit(name).alias("name"), F.expr(xml).cast("binary").alias("data")))


def _sheet_xml() -> str:
    tag = lambda before, value, after: f"coalesce(concat('{before}', CAST({value} AS STRING), '{after}'), '')"
    each = []
    for sid, name, parent, font, size in (tuple(x.format(d="doc_id") for x in row) for row in SHEET):
        first = ' w:default="1"' if sid == "'Base'" else ""
        each += [f"'<w:style w:type=\"paragraph\"{first} w:styleId=\"'", sid, "'\"><w:name w:val=\"'", name, "'\"/>'", tag('<w:basedOn w:val="', parent, '"/>'), "'<w:rPr>'", tag('<w:rFonts w:ascii="', font, '"/>'), tag('<w:sz w:val="', f"CAST(2 * ({size}) AS INT)", '"/>'), "'</w:rPr></w:style>'"]
    return f"concat('<w:styles>{DEFAULTS}', {', '.join(each)}, '</w:styles>')"


def package_styles(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2: runs and headings whose looks come from chains of parent styles, from defaults, or from the run itself."""
    chosen = F.expr("CASE idx % 8 WHEN 1 THEN 'L1' WHEN 2 THEN 'L2' WHEN 3 THEN 'L3' WHEN 4 THEN 'H2' WHEN 5 THEN 'Sub' WHEN 6 THEN 'Loop' WHEN 7 THEN 'Gone' END")
    style = F.coalesce(F.concat(F.lit('<w:pPr><w:pStyle w:val="'), chosen, F.lit('"/></w:pPr>')), F.lit(""))
    own = F.when((F.col("doc_id") + F.col("idx")) % 5 == 0, '<w:rPr><w:rFonts w:ascii="Georgia"/><w:sz w:val="16"/></w:rPr>').otherwise("")
    xml = F.concat(F.lit("<w:p>"), style, F.lit("<w:r>"), own, F.lit('<w:t xml:space="preserve">'), _escaped(clean("text")), F.lit("</w:t></w:r></w:p>"))
    t = packages.tables_of(packed(manuscripts(spark, d).select("doc_id", "idx", xml.alias("xml")), _part("word/styles.xml", _sheet_xml())), once=True)
    both = t["runs"].join(t["para_format"], ["path", "idx"])
    return packages.by_document(both.select("path", "idx", "style", "outline_level", F.col("font_name").alias("font"), F.col("font_size_pt").alias("size"), F.length("text").alias("n_chars")))


def package_cells(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2: cells of tables of two rows and three columns, each second column with a table of its own between two paragraphs."""
    p = manuscripts(spark, d)
    last = F.col("idx") == F.col("last")
    ends = p.groupBy("doc_id").agg(F.max("idx").alias("last"))
    text = _escaped(clean("text"))
    para = lambda x: F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), x, F.lit("</w:t></w:r></w:p>"))
    when = lambda c, x: F.when(c, x).otherwise("")
    nested = F.concat(F.lit("<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in "), F.col("idx").cast("string"), F.lit("</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"), para(F.lit("after")))
    xml = F.concat(when(F.col("idx") % 6 == 0, "<w:p/><w:tbl>"), when(F.col("idx") % 3 == 0, "<w:tr>"), F.lit("<w:tc>"), para(text), when(F.col("idx") % 3 == 1, nested), F.lit("</w:tc>"), when((F.col("idx") % 3 == 2) | last, "</w:tr>"), when((F.col("idx") % 6 == 5) | last, "</w:tbl>"))
    t = packages.tables_of(packed(p.join(ends, "doc_id").select("doc_id", "idx", xml.alias("xml"))), once=True)
    # merged: the tables' rows look few by the size of the blocks' files, and would be broadcast
    both = t["cells"].join(t["tables"].select("path", "table_no", "after_idx").hint("merge"), ["path", "table_no"])
    return packages.by_document(both.select("path", "table_no", "depth", "row", "col", "text", "after_idx"))


#: A list of three levels, of which the second starts at 3, and a list of bullets.
LISTS = (
    '<w:numbering><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="3"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl>'
    '<w:lvl w:ilvl="2"><w:numFmt w:val="upperRoman"/><w:lvlText w:val="(%3)"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="8"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="●"/></w:lvl></w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="8"/></w:num></w:numbering>'
)
#: A paragraph's place in the lists: level, or null; bullets are the list's second.
LEVEL = "CASE (doc_id * 5 + idx * 3) % 7 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 2 END"


def _numbered(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    level = F.expr(LEVEL)
    mark = lambda num, lvl: F.concat(F.lit('<w:pPr><w:numPr><w:ilvl w:val="'), lvl, F.lit(f'"/><w:numId w:val="{num}"/></w:numPr></w:pPr>'))
    listed = F.when(F.col("idx") % 11 == 0, mark(2, F.lit("0"))).when(level.isNotNull(), mark(1, level.cast("string"))).otherwise("")
    xml = F.concat(F.lit("<w:p>"), listed, F.lit('<w:r><w:t xml:space="preserve">'), _escaped(clean("text")), F.lit("</w:t></w:r></w:p>"))
    t = packages.tables_of(packed(manuscripts(spark, d).select("doc_id", "idx", xml.alias("xml")), _part("word/numbering.xml", f"'{LISTS}'")), once=True)
    return {k: packages.by_document(t[k]) for k in ("para_format", "list_levels", "paragraphs")}


def package_outline(spark: SparkSession, d: str) -> DataFrame:
    """WN-16: the numbers that list numbering prints before the manuscripts' paragraphs."""
    t = _numbered(spark, d)
    return styles.outline_numbers(t["para_format"], t["list_levels"])


def package_headings(spark: SparkSession, d: str) -> DataFrame:
    """WN-16: headings that list numbering numbers."""
    t = _numbered(spark, d)
    return layout.auto_numbered(t["paragraphs"], styles.outline_numbers(t["para_format"], t["list_levels"]))


def _pictured(spark: SparkSession, d: str, linked: str = "true") -> DataFrame:
    """Packages with a picture, PNG or JPEG, for every third paragraph; those of the condition `linked` have a relationship too."""
    rows = structure.table(spark, d, structure.IMAGES)
    number = F.col("image_no").cast("string")
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexed("px_w", 8), hexed("px_h", 8), F.lit("0802000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC400040000FFC0001108"), hexed("px_h", 4), hexed("px_w", 4), F.lit("03011100"))
    is_png = (F.col("image_no") % 2 == 0) | (F.col("px_w") > 65535)
    ext = F.when(is_png, "png").otherwise("jpg")
    name = F.concat(F.lit("image"), number, F.lit("."), ext)
    emu = lambda c: (F.col(c) * packages.EMU_PER_INCH).cast("bigint").cast("string")
    xml = F.concat(F.lit('<w:p><w:r><w:drawing><wp:inline><wp:extent cx="'), emu("in_w"), F.lit('" cy="'), emu("in_h"), F.lit('"/><a:graphic><a:blip r:embed="rId'), number, F.lit('"/></a:graphic></wp:inline></w:drawing></w:r></w:p>'))
    media = F.array(F.struct(F.concat(F.lit("word/media/"), name).alias("name"), F.unhex(F.when(is_png, png).otherwise(jpeg)).alias("data")))
    link = F.concat(F.lit('<Relationship Id="rId'), number, F.lit('" Type="image" Target="media/'), name, F.lit('"/>'))
    rels = rows.filter(linked).withColumn("link", link).groupBy("doc_id").agg(F.concat(F.lit("<Relationships>"), F.array_join(F.sort_array(F.collect_list("link")), ""), F.lit("</Relationships>")).alias("xml"))
    made = rows.select("doc_id", F.col("image_no").alias("idx"), xml.alias("xml"), media.alias("parts"))
    return packed(made.unionByName(rels.select("doc_id", F.lit(-1).alias("idx"), F.lit("").alias("xml"), F.array(F.struct(F.lit("word/_rels/document.xml.rels").alias("name"), F.col("xml").cast("binary").alias("data"))).alias("parts"))))


def package_images(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2, MS-16: pictures' pixels from their files' headers, and their resolution on the page."""
    images = packages.by_document(packages.tables_of(_pictured(spark, d))["images"])
    poor = scans.image_resolution(images).select("doc_id", "image_no", "severity", "dpi")
    return images.select("doc_id", "image_no", "fmt", "px_w", "px_h", "in_w", "in_h", "kb").join(poor, ["doc_id", "image_no"], "left")


def package_media(spark: SparkSession, d: str) -> DataFrame:
    """AG-30: pictures of packages that nothing in them points at."""
    t = packages.tables_of(_pictured(spark, d, "(doc_id + image_no) % 4 <> 0"))
    return layout.missing_parts(packages.by_document(t["parts"]), packages.by_document(t["rels"]))


#: What the tables of document {d} state, by edge; their captions' and notes' looks follow too.
TABLE = "CASE doc_id % 4 WHEN 0 THEN '<w:tblBorders><w:top w:val=\"single\" w:sz=\"4\"/><w:left w:val=\"single\" w:sz=\"4\"/></w:tblBorders>' WHEN 1 THEN '<w:tblBorders><w:top w:val=\"double\" w:sz=\"12\"/></w:tblBorders>' WHEN 2 THEN '<w:tblBorders><w:top w:val=\"single\" w:sz=\"4\"/><w:bottom w:val=\"dotted\" w:sz=\"8\"/></w:tblBorders>' ELSE '' END"
MARGINS = "CASE doc_id % 3 WHEN 0 THEN '<w:tblCellMar><w:top w:w=\"29\"/><w:left w:w=\"58\"/><w:bottom w:w=\"29\"/><w:right w:w=\"58\"/></w:tblCellMar>' WHEN 1 THEN '<w:tblCellMar><w:top w:w=\"100\"/><w:left w:w=\"100\"/><w:bottom w:w=\"100\"/><w:right w:w=\"100\"/></w:tblCellMar>' ELSE '' END"


def package_table_format(spark: SparkSession, d: str) -> DataFrame:
    """JN-29: tables of packages against the table specification: a caption of two runs, the manuscript's paragraphs as cells, and a note."""
    p = manuscripts(spark, d)
    run = lambda font, size, bold, text: F.concat(F.lit('<w:r><w:rPr><w:rFonts w:ascii="'), font, F.lit('"/><w:sz w:val="'), size, F.lit('"/>'), bold, F.lit('</w:rPr><w:t xml:space="preserve">'), text, F.lit("</w:t></w:r>"))
    say = lambda sql: F.expr(sql)
    house, bold, plain = F.lit("Times New Roman"), F.lit("<w:b/>"), F.lit('<w:b w:val="0"/>')
    caption_font, caption_size = say("CASE WHEN doc_id % 5 = 0 THEN 'Cambria' ELSE 'Times New Roman' END"), say("CASE WHEN doc_id % 7 = 0 THEN '24' ELSE '22' END")
    caption = F.concat(F.lit("<w:p>"), run(caption_font, caption_size, bold, F.lit("Table 1. ")), run(caption_font, caption_size, say("CASE WHEN doc_id % 2 = 0 THEN '<w:b/>' ELSE '<w:b w:val=\"0\"/>' END"), F.lit("What was counted in all of the places")), F.lit("</w:p>"))
    start = F.concat(caption, F.lit("<w:tbl><w:tblPr>"), say(TABLE), say(MARGINS), F.lit("</w:tblPr>"))
    head = F.col("idx") == 0
    cell_font, cell_size = say("CASE WHEN (doc_id + idx) % 9 = 0 THEN 'Courier New' ELSE 'Times New Roman' END"), say("CASE WHEN (doc_id * 3 + idx) % 8 = 0 THEN '20' ELSE '18' END")
    cell = F.concat(F.lit("<w:tr><w:tc><w:p>"), run(cell_font, cell_size, F.when(head & (F.col("doc_id") % 3 == 0), plain).when(head, bold).otherwise(plain), _escaped(clean("text"))), F.lit("</w:p></w:tc></w:tr>"))
    note = F.concat(F.lit("<w:p>"), run(house, say("CASE WHEN doc_id % 6 = 0 THEN '22' ELSE '18' END"), plain, F.lit("Note: as counted")), F.lit("</w:p>"))
    last = p.groupBy("doc_id").agg(F.max("idx").alias("last"))
    xml = F.concat(F.when(head, start).otherwise(""), cell, F.when(F.col("idx") == F.col("last"), F.concat(F.lit("</w:tbl>"), note)).otherwise(""))
    t = packages.tables_of(packed(p.join(last, "doc_id").select("doc_id", "idx", xml.alias("xml"))), once=True)
    own = {k: packages.by_document(t[k]) for k in ("tables", "cell_runs", "paragraphs", "runs")}
    return table_rules.table_format(table_rules.measurements(own["tables"], own["cell_runs"], own["paragraphs"], own["runs"]))


def _sheet_sql() -> str:
    rows = [tuple(x.format(d="doc_id") for x in row) for row in SHEET]
    return " UNION ALL ".join(f"SELECT doc_id, {sid} AS id, {name} AS name, CAST({parent} AS VARCHAR) AS parent, CAST({font} AS VARCHAR) AS font, CAST({size} AS DOUBLE) AS size FROM d" for sid, name, parent, font, size in rows)


PLAIN = f"regexp_replace(text, '{CONTROL}', ' ', 'g')"
ROMAN = "concat(['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][({n} // 10) % 10 + 1], ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][{n} % 10 + 1])"
LETTER = "repeat(chr(CAST(97 + ({n} - 1) % 26 AS INTEGER)), CAST(({n} - 1) // 26 + 1 AS INTEGER))"
ROMAN_100 = "concat(['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][({n} // 100) % 10 + 1], " + ROMAN + ")"
LABELS = f"""SELECT doc_id, idx, text, CAST(level AS INTEGER) AS level, CASE level WHEN 0 THEN concat(greatest(c0, 1), '.') WHEN 1 THEN concat(greatest(c0, 1), '.', {LETTER.format(n='(greatest(c1, 1) + 2)')}, ')') ELSE concat('(', {ROMAN_100.format(n='greatest(c2, 1)')}, ')') END AS label FROM (
    SELECT *, count(*) FILTER (level = 0) OVER (PARTITION BY doc_id ORDER BY idx) AS c0, count(*) FILTER (level = 1) OVER (PARTITION BY doc_id, g1 ORDER BY idx) AS c1, count(*) FILTER (level = 2) OVER (PARTITION BY doc_id, g2 ORDER BY idx) AS c2 FROM (
      SELECT *, count(*) FILTER (level = 0) OVER w AS g1, count(*) FILTER (level < 2) OVER w AS g2 FROM (SELECT doc_id, idx, {PLAIN} AS text, {LEVEL} AS level FROM p WHERE idx % 11 <> 0) a WHERE level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) b) c"""
SMALL = ", ".join(f"'{w}'" for w in layout.TITLE_WORDS)
SPEC = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in table_rules.SPECIFICATION)

SQL = {
    "package_styles": f"""WITH RECURSIVE d AS (SELECT DISTINCT doc_id FROM p), s AS ({_sheet_sql()}), up AS (
        SELECT doc_id, id, 0 AS step, name, parent, font, size FROM s UNION ALL SELECT u.doc_id, u.id, u.step + 1, s.name, s.parent, s.font, s.size FROM up u JOIN s ON s.doc_id = u.doc_id AND s.id = u.parent WHERE u.step < 7
      ), looks AS (
        SELECT doc_id, id, coalesce(arg_min(font, step) FILTER (font IS NOT NULL), 'Calibri') AS font, coalesce(arg_min(size, step) FILTER (size IS NOT NULL), 12.0) AS size,
          arg_min(try_cast(regexp_extract(name, '(?i)^heading ([1-9])$', 1) AS INTEGER) - 1, step) FILTER (step < 5 AND regexp_matches(name, '(?i)^heading [1-9]$')) AS level, max(name) FILTER (step = 0) AS name FROM up GROUP BY doc_id, id
      ) SELECT p.doc_id, p.idx, l.name AS style, l.level AS outline_level, CASE WHEN (p.doc_id + p.idx) % 5 = 0 THEN 'Georgia' ELSE l.font END AS font, CASE WHEN (p.doc_id + p.idx) % 5 = 0 THEN 8.0 ELSE l.size END::DOUBLE AS size, CAST(length({PLAIN}) AS INTEGER) AS n_chars
      FROM p JOIN looks l ON l.doc_id = p.doc_id AND l.id = CASE p.idx % 8 WHEN 1 THEN 'L1' WHEN 2 THEN 'L2' WHEN 3 THEN 'L3' WHEN 4 THEN 'H2' WHEN 5 THEN 'Sub' WHEN 6 THEN 'Loop' ELSE 'Base' END""",
    "package_cells": f"""WITH t AS (SELECT doc_id, idx, 1 AS depth, CAST((idx // 3) % 2 AS INTEGER) AS row, CAST(idx % 3 AS INTEGER) AS col, {PLAIN} || CASE WHEN idx % 3 = 1 THEN chr(10) || 'after' ELSE '' END AS text FROM p
        UNION ALL SELECT doc_id, idx, 2, 0, k, CASE k WHEN 0 THEN concat('in ', idx) ELSE '' END FROM p, (SELECT unnest([0, 1]) AS k) x WHERE idx % 3 = 1
      ), n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY idx - CASE depth WHEN 1 THEN idx % 6 ELSE 0 END, depth) - 1 AS table_no FROM t)
      SELECT doc_id, CAST(table_no AS INTEGER) AS table_no, CAST(depth AS INTEGER) AS depth, row, CAST(col AS INTEGER) AS col, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, CAST(idx // 6 AS INTEGER) AS after_idx FROM n""",
    "package_outline": f"SELECT doc_id, idx, level, label FROM ({LABELS}) x",
    "package_headings": f"""SELECT doc_id, idx, label FROM ({LABELS}) x WHERE length(trim(text)) BETWEEN 1 AND 70 AND NOT regexp_matches(trim(text), '[.!?,;]$') AND len(regexp_split_to_array(trim(text), '\\s+')) <= 9
      AND ((trim(text) = upper(trim(text)) AND regexp_matches(text, '\\p{{L}}')) OR len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: regexp_matches(w, '^\\p{{L}}') AND NOT regexp_matches(w, '^\\p{{Lu}}') AND lower(w) NOT IN ({SMALL}))) = 0)""",
    "package_images": f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY image_no) - 1 AS k FROM ({structure.duck(structure.IMAGES)}) q), t AS (SELECT *, round_even(least(px_w / in_w, px_h / in_h), 0) AS dpi FROM i)
      SELECT doc_id, CAST(k AS INTEGER) AS image_no, CASE WHEN image_no % 2 = 0 OR px_w > 65535 THEN 'PNG' ELSE 'JPEG' END AS fmt, px_w, px_h, in_w, in_h, 0 AS kb, CASE WHEN in_w > 0.5 AND in_h > 0.5 AND dpi < 150 THEN 'error' WHEN in_w > 0.5 AND in_h > 0.5 AND dpi < 300 THEN 'warning' END AS severity,
        CASE WHEN in_w > 0.5 AND in_h > 0.5 AND dpi < 300 THEN CAST(dpi AS INTEGER) END AS dpi FROM t""",
    "package_media": f"SELECT doc_id, concat('word/media/image', image_no, CASE WHEN image_no % 2 = 0 OR px_w > 65535 THEN '.png' ELSE '.jpg' END) AS media FROM ({structure.duck(structure.IMAGES)}) i WHERE (doc_id + image_no) % 4 = 0",
    "package_table_format": f"""WITH d AS (SELECT DISTINCT doc_id FROM p), spec(scope, attribute, least, most, want, rule, severity) AS (VALUES {SPEC}), m AS (
        SELECT doc_id, 'any' AS scope, 'border_style' AS attribute, NULL::DOUBLE AS number, CASE doc_id % 4 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'mixed:dotted,single' END AS word FROM d
        UNION ALL SELECT doc_id, 'any', 'border_size_pt', CASE doc_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 END, NULL FROM d
        UNION ALL SELECT doc_id, 'any', concat('margin_', side, '_in'), CASE doc_id % 3 WHEN 0 THEN CASE WHEN side IN ('top', 'bottom') THEN 0.02 ELSE 0.04 END WHEN 1 THEN 0.069 END, NULL FROM d, (SELECT unnest(['top', 'bottom', 'left', 'right']) AS side) s
        UNION ALL SELECT doc_id, CASE idx WHEN 0 THEN 'head' ELSE 'cell' END, 'font', NULL, CASE WHEN (doc_id + idx) % 9 = 0 THEN 'Courier New' ELSE 'Times New Roman' END FROM p WHERE trim({PLAIN}, ' ') <> ''
        UNION ALL SELECT doc_id, CASE idx WHEN 0 THEN 'head' ELSE 'cell' END, 'size', CASE WHEN (doc_id * 3 + idx) % 8 = 0 THEN 10.0 ELSE 9.0 END, NULL FROM p WHERE trim({PLAIN}, ' ') <> ''
        UNION ALL SELECT doc_id, 'head', 'bold', CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE 1.0 END, NULL FROM p WHERE idx = 0
        UNION ALL SELECT doc_id, 'caption', 'font', NULL, CASE WHEN doc_id % 5 = 0 THEN 'Cambria' ELSE 'Times New Roman' END FROM d
        UNION ALL SELECT doc_id, 'caption', 'size', CASE WHEN doc_id % 7 = 0 THEN 12.0 ELSE 11.0 END, NULL FROM d
        UNION ALL SELECT doc_id, 'caption', 'weights', CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 2.0 END, NULL FROM d
        UNION ALL SELECT doc_id, 'note', 'size', CASE WHEN doc_id % 6 = 0 THEN 11.0 ELSE 9.0 END, NULL FROM d
      ), held AS (SELECT m.*, s.* EXCLUDE (scope, attribute), row_number() OVER (PARTITION BY m.doc_id, m.scope, m.attribute, s.scope) AS x, s.scope AS ruled, m.scope AS own FROM m JOIN spec s ON s.attribute = m.attribute AND (s.scope = m.scope OR (s.scope = 'any' AND NOT EXISTS (SELECT 1 FROM spec z WHERE z.attribute = m.attribute AND z.scope = m.scope))))
      SELECT doc_id, 0 AS table_no, rule, attribute, CASE WHEN attribute = 'border_style' AND word IS NULL THEN 'info' ELSE severity END AS severity, count(*) AS n, string_agg(DISTINCT coalesce(word, printf('%.3f', number), 'not stated'), ', ' ORDER BY coalesce(word, printf('%.3f', number), 'not stated')) AS found
      FROM held WHERE (attribute = 'border_style' AND word IS NULL) OR word <> want OR number < least OR number > most GROUP BY ALL""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (package_styles, package_cells, package_outline, package_headings, package_images, package_media, package_table_format)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    def views(sql: str) -> str:
        return f"WITH RECURSIVE {with_views(sql.replace('WITH RECURSIVE', 'WITH', 1))[5:]}" if "RECURSIVE" in sql else with_views(sql)

    return {name: views(sql) for name, sql in SQL.items()}
