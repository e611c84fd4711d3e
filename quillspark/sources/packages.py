"""Office packages: files of a directory as tables of text, runs, cells, sections and images.

A file is read and unzipped in the task that holds it; its members leave as XML
text, and Spark's XPath functions make the tables.  Namespace prefixes are cut.
Tables nest: how deep a paragraph stands is a running sum over the tags that open
and close.  Text boxes aren't part of the text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import styles, xml
from .pictures import header
from .sinks import written

# First bytes of other formats.
SIGNATURES = (("25504446", "PDF"), ("D0CF11E0A1B11AE1", "old Word"), ("7B5C727466", "RTF"), ("3C3F786D6C", "XML"), ("3C68746D6C", "HTML"), ("3C21444F43545950", "HTML"))
EMU_PER_INCH = 914400
#: Characters of results that a task gathers before it hands them to Spark.
PIECE = 1 << 22


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def in_pieces(rows: Iterable[tuple], columns: list[str], size=lambda row: sum(len(x) for x in row if isinstance(x, str | bytes))) -> Iterator[pd.DataFrame]:
    """Rows as frames of some PIECE characters, so that a task holds few of a batch's results at once."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= PIECE:
            yield pd.DataFrame(held, columns=columns)
            held, total = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            found = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        xml = None
                        if name.endswith((".xml", ".rels")):
                            xml = _clean(z.read(name))
                        found.append((path, name, xml))
            except zipfile.BadZipFile:
                found.append((path, None, None))
            yield from found

    for batch in batches:
        yield from in_pieces(rows(batch), ["path", "member", "xml"])


def members(packages: DataFrame) -> DataFrame:
    """UDF-2: (path, member, xml) of zip files; a damaged one has a single row without a member."""
    return packages.filter(F.substring("content", 1, 2) == F.lit("PK").cast("binary")).select("path", "content").mapInPandas(_members, "path string, member string, xml string")


def triage_files(packages: DataFrame) -> DataFrame:
    """SRC-4: (path, ok, reason): why a file isn't a Word package, by its first bytes and members; Spark's file scan passes over files of no bytes."""
    head = F.hex(F.substring("content", 1, 8))
    kind = F.coalesce(*[F.when(head.startswith(sig), F.lit(what)) for sig, what in SIGNATURES])
    inside = members(packages).groupBy("path").agg(F.collect_set("member").alias("names"))
    both = packages.select("path", "length", head.alias("head"), kind.alias("kind")).join(inside, "path", "left")
    has = lambda p: F.exists("names", lambda x: x.startswith(p))
    reason = (
        F.when(F.col("length") == 0, "empty")
        .when(F.col("kind").isNotNull(), F.col("kind"))
        .when(~F.col("head").startswith("504B"), "not an Office file")
        .when(F.size("names") == 0, "damaged")
        .when(F.array_contains("names", "word/document.xml"), None)
        .when(has("ppt/"), "PowerPoint")
        .when(has("xl/"), "Excel")
        .otherwise("not a Word document")
    )
    return both.select("path", reason.isNull().alias("ok"), reason.alias("reason"))


MEDIA = "array<struct<name:string,fmt:string,px_w:int,px_h:int,kb:int>>"
PARTS = {"document": "word/document.xml", "styles": "word/styles.xml", "numbering": "word/numbering.xml", "rels": "word/_rels/document.xml.rels"}


def _clean(data: bytes) -> str:
    """XML without namespaces."""
    bare = re.sub(r"\sxmlns(:\w+)?=\"[^\"]*\"", "", re.sub(r"<(/?)\w+:", r"<\1", data.decode("utf-8", "replace")))
    return re.sub(r"(\s)\w+:(\w+=)", r"\1\2", re.sub(r"^<\?xml[^>]*\?>", "", bare.lstrip("\ufeff")))


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(batch: pd.DataFrame) -> Iterator[tuple]:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = set(z.namelist())
                    parts = [_clean(z.read(n)) if n in names else None for n in PARTS.values()]
                    media = []
                    for info in z.infolist():
                        if info.filename.startswith("word/media/"):
                            fmt, width, height = header(z.read(info)) or (None, None, None)
                            media.append({"name": info.filename, "fmt": fmt, "px_w": width, "px_h": height, "kb": info.file_size // 1024})
            except zipfile.BadZipFile:
                continue
            yield (path, *parts, media, None if parts[0] is None else np.array(_places(parts[0]), dtype=np.int32))

    for batch in batches:
        yield from in_pieces(rows(batch), ["path", *PARTS, "media", "place"])


def opened(packages: DataFrame) -> DataFrame:
    """(path, document, styles, numbering, rels, media, place): one row for each readable package, its parts as XML, its pictures' sizes and PLACE of the document's pieces."""
    return packages.filter(F.substring("content", 1, 2) == F.lit("PK").cast("binary")).select("path", "content").mapInPandas(_opened, f"path string, {', '.join(f'{k} string' for k in PARTS)}, media {MEDIA}, place array<int>")


TAGS = "tbl|tr|tc|p"
BOXES = r"(?s)<txbxContent(?: [^>]*)?>.*?</txbxContent>"
EMPTY = rf"<({TAGS})((?: [^>]*?)?)/>"


def _pieces() -> Column:
    """A document's XML, cut before and behind the tags of blocks."""
    text = F.regexp_replace("document", BOXES, "")
    text = F.regexp_replace(text, EMPTY, "<$1$2></$1>")
    return F.split(text, rf"(?=<(?:{TAGS})[ >])|(?<=</(?:{TAGS})>)")


#: What a piece's place is made of: 1 for a paragraph, 2 for a table's head, 0 for others; the tables opened so far; those around it; where it is in the innermost; the body's paragraphs so far.
PLACE = ("kind", "n_opened", "depth", "table_no", "row", "col", "para_no", "n_body")


def _kinds(document: str) -> Iterator[tuple[str, bool]]:
    """Of each piece that _pieces() makes of a document, the block that it opens and whether it closes a table; an empty piece at the end is left out."""
    text = re.sub(EMPTY, r"<\1\2></\1>", re.sub(BOXES, "", document))
    kind, start = "", 0
    for m in re.finditer(rf"<({TAGS})[ >]|</({TAGS})>", text):
        if m[1]:
            if m.start() > start:
                yield kind, False
            kind, start = m[1], m.start()
        else:
            yield kind, m[2] == "tbl"
            kind, start = "", m.end()
    if start < len(text):
        yield kind, False


def _places(document: str) -> list[int]:
    """PLACE of each piece, one after the other: counters that run over a document's pieces; those of a table go on behind what is nested in it.  Outside tables, table, row and cell mean nothing; pieces that open no block have zeros."""
    out, n_opened, closed, n_body = [], 0, 0, 0
    last: dict[int, int] = {}  # by depth, the table that opened last
    inner: dict[int, list[int]] = {}  # of each table, the row, the cell in it, and the paragraphs in that
    none = (0,) * len(PLACE)
    for kind, closes in _kinds(document):
        n_opened += kind == "tbl"
        depth = n_opened - closed
        closed += closes
        if not kind:
            out += none
        elif depth > 0:
            if kind == "tbl":
                last[depth] = n_opened - 1
                inner[n_opened - 1] = [-1, -1, 0]
            table = last[depth]
            now = inner[table]
            if kind == "p":
                now[2] += 1
            elif kind == "tc":
                now[1:] = now[1] + 1, 0
            elif kind == "tr":
                now[:] = now[0] + 1, -1, 0
            out += (BLOCKS.get(kind, 0), n_opened, depth, table, now[0], now[1], now[2] - 1, n_body)
        else:
            n_body += kind == "p"
            out += (BLOCKS.get(kind, 0), n_opened, depth, -1, -1, -1, n_body - 1, n_body)
    return out


BLOCKS = {"p": 1, "tbl": 2}


def _placed(packages: DataFrame, piece: Callable[[Column], Column]) -> DataFrame:
    """packages (path, pieces, place, others) as rows (others, pos, b, and PLACE with the kind's name) of their paragraphs and tables' heads; b: piece() of a piece.

    A package's pieces and places are one row, so this needs neither a shuffle nor a sort.
    """
    others = [c for c in packages.columns if c not in ("pieces", "place")]
    of = {c: F.get("place", F.col("pos") * len(PLACE) + k) for k, c in enumerate(PLACE)}
    some = packages.select(*others, "place", F.posexplode(F.transform("pieces", piece)).alias("pos", "b")).filter(of["kind"] > 0)
    of["kind"] = F.when(of["kind"] == BLOCKS["p"], "p").otherwise("tbl")
    inside = {c: F.when(of["depth"] > 0, x) if c in ("table_no", "row", "col") else x for c, x in of.items()}
    return some.select(*others, "pos", "b", *[x.alias(c) for c, x in inside.items()])


def blocks(packages: DataFrame) -> DataFrame:
    """(path, pos, xml, kind, depth, table_no, row, col, para_no, look, levels): paragraphs and tables' heads, in order.

    depth counts the tables around a block.  table_no numbers tables, nested ones
    too, as they open; row, col and para_no count within the innermost table, whose
    opening is the last one at that depth.  look: the paragraph style with what it
    inherits; levels: the package's list levels.
    """
    font, size = styles.defaults(F.col("styles"))
    sheet = packages.select("path", _pieces().alias("pieces"), "place", styles.declared(F.coalesce("styles", F.lit("<styles/>"))).alias("declared"), font.alias("font"), size.alias("size"), styles.list_levels(F.coalesce("numbering", F.lit("<numbering/>"))).alias("levels"))
    sheet = sheet.select("path", "pieces", "place", "levels", "font", "size", styles.resolved(F.col("declared"), F.col("font"), F.col("size")).alias("known"))
    plain = styles.first_of(F.col("known"), lambda s: s["by_default"] & (s["kind"] == "paragraph"))

    def with_style(piece: Column) -> Column:
        named = lambda tag: styles.at(tag, "/pStyle/@val")
        wanted = lambda name: F.coalesce(styles.first_of(F.col("known"), lambda s: s["id"] == name), plain)
        look = xml.let(xml.let(F.regexp_extract(piece, r"<pStyle [^>]*/>", 0), named), wanted)
        return F.struct(piece.alias("xml"), F.when(piece.rlike(r"^<p[ >]"), look).alias("look"))

    deep = _placed(sheet, with_style)
    return deep.select("path", "levels", "font", "size", "pos", "b.xml", "b.look", *[c for c in deep.columns if c not in ("path", "levels", "font", "size", "known", "pos", "b")])


def _paragraph_xml(packages: DataFrame) -> DataFrame:
    """(path, idx, xml): body paragraphs outside tables, numbered as in blocks(), which needs their place in tables and their style too."""
    body = _placed(opened(packages).select("path", _pieces().alias("pieces"), "place"), lambda x: x).filter("kind = 'p' AND depth = 0")
    return body.select("path", F.col("para_no").alias("idx"), F.col("b").alias("xml"))


def ingest_packages(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-2: tables_of() all packages below a folder."""
    return tables_of(files(spark, path))


def by_document(rows: DataFrame) -> DataFrame:
    """Rows keyed by path as the scans read them: doc_id is the number that the file's name ends with, else a hash of the path."""
    number = F.nullif(F.regexp_extract("path", r"(\d{1,18})\.\w+$", 1), F.lit(""))
    return rows.select(F.coalesce(number.cast("bigint"), F.xxhash64("path")).alias("doc_id"), *[c for c in rows.columns if c != "path"])


def runs_of(blocks: DataFrame, *keys: str) -> DataFrame:
    """(path, keys, run_no, text, bold, italic, underline, superscript, subscript, font_name, font_size_pt): a paragraph's runs; fonts that a run doesn't state come from its style."""
    # each value in a let(): together their code is more than the JVM compiles, and then it takes twice the time
    of = lambda use: xml.let(F.col("r"), use)
    on = lambda name: of(lambda r: F.when(xml.has(r, f"/r/rPr/{name}"), ~F.coalesce(styles.at(r, f"/r/rPr/{name}/@val").isin("0", "false", "none"), F.lit(False))))
    marks = F.regexp_replace(F.replace("xml", F.lit("<tab/>"), F.lit("<t>\t</t>")), r"<(?:br|cr)(?: [^>]*)?/>", "<t>\n</t>")
    marks = F.replace(marks, F.lit("<noBreakHyphen/>"), F.lit("<t>-</t>"))
    run = blocks.select("path", *keys, "look", "font", "size", F.posexplode(F.regexp_extract_all(marks, F.lit(r"(?s)<r(?: [^>]*)?>.*?</r>"), F.lit(0))).alias("run_no", "r"))
    raised = of(lambda r: F.coalesce(styles.at(r, "/r/rPr/vertAlign/@val"), F.lit("")))
    size = of(lambda r: F.round(styles.at(r, "/r/rPr/sz/@val").cast("double") / 2, 1))
    return run.select(
        "path", *keys, "run_no", of(xml.run_text).alias("text"), on("b").alias("bold"), on("i").alias("italic"), on("u").alias("underline"),
        (raised == "superscript").alias("superscript"), (raised == "subscript").alias("subscript"), F.coalesce(of(lambda r: styles.at(r, "/r/rPr/rFonts/@ascii")), F.col("look.font"), F.col("font")).alias("font_name"), F.coalesce(size, F.col("look.size"), F.col("size")).alias("font_size_pt"),
    )


def tables_of(packages: DataFrame, once: bool = False) -> dict[str, DataFrame]:
    """SRC-2: paragraphs, runs, para_format, cells, cell_runs, tables, sections, images, list levels, parts and rels of packages (path, content), keyed by path.

    once: the packages' XML and blocks are written as tables of the shared folder, for
    a caller that reads several of the results; else each of them unzips again.
    """
    whole = opened(packages)
    whole = written(whole, "packages", "zstd") if once else whole
    block = blocks(whole)
    block = written(block, "blocks", "zstd") if once else block
    para = block.filter("kind = 'p' AND depth = 0").withColumn("idx", F.col("para_no"))
    runs = runs_of(para, "idx")
    some = lambda p: styles.at(F.col("xml"), p)
    own = some("/p/pPr/outlineLvl/@val")
    level = F.coalesce(F.when(own.rlike("^[0-8]$"), own.cast("int")), F.col("look.level"), F.when(F.col("look.id").isNull(), styles.heading_level(some("/p/pPr/pStyle/@val"))))  # without a style sheet the id is the name
    # Newer names of alignments.
    align = F.coalesce(*[F.when(some("/p/pPr/jc/@val") == new, old) for new, old in (("start", "left"), ("end", "right"), ("both", "justify"))], some("/p/pPr/jc/@val"))
    num_id, num_level = F.coalesce(some("/p/pPr/numPr/numId/@val"), F.col("look.num_id")), F.when(some("/p/pPr/numPr/numId/@val").isNotNull(), some("/p/pPr/numPr/ilvl/@val").cast("int")).otherwise(F.col("look.num_level"))
    inches = lambda p: F.round(some(p).cast("double") / 1440, 3)
    points = lambda p: F.round(some(p).cast("double") / 20, 1)
    formats = para.select(
        "path", "idx", F.col("look.name").alias("style"), level.alias("outline_level"), align.alias("alignment"), num_id.alias("num_id"), styles.listing(F.col("levels"), num_id, F.coalesce(num_level, F.lit(0))).alias("listing"),
        F.coalesce(inches("/p/pPr/ind/@firstLine"), -inches("/p/pPr/ind/@hanging")).alias("first_line_in"), F.coalesce(inches("/p/pPr/ind/@left"), inches("/p/pPr/ind/@start")).alias("left_indent_in"),
        points("/p/pPr/spacing/@before").alias("space_before_pt"), points("/p/pPr/spacing/@after").alias("space_after_pt"), F.when(F.coalesce(some("/p/pPr/spacing/@lineRule"), F.lit("auto")) == "auto", some("/p/pPr/spacing/@line").cast("double") / 240).alias("line_spacing"),
    )
    place = ["table_no", "row", "col", "para_no"]
    in_cells = block.filter("kind = 'p' AND depth > 0")
    cell_runs = runs_of(in_cells, *place)
    # dealt by table, so that what tells of tables meets their cells where they are
    texts = in_cells.select("path", "depth", *place, xml.text_of(F.col("xml"), "t").alias("text")).repartition("path", "table_no").groupBy("path", "table_no", "depth", "row", "col")
    cells = texts.agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda x: x["text"]), "\n"), r"^\s+|\s+$", "").alias("text"))
    heads = block.filter("kind = 'tbl'").withColumn("xml", F.concat("xml", F.lit("</tbl>")))
    border = "/tbl/tblPr/tblBorders/*[self::top or self::left or self::bottom or self::right or self::insideH or self::insideV]"
    kinds, sizes = F.array_sort(F.array_distinct(F.xpath("xml", F.lit(f"{border}/@val")))), F.transform(F.filter(F.xpath("xml", F.lit(f"{border}/@sz")), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int") / 8)
    edge = lambda side: F.round(some(f"/tbl/tblPr/tblCellMar/{side}/@w").cast("int") / 1440, 3).alias(f"margin_{side}_in")
    tables = heads.select(
        "path", "table_no", "depth", (F.col("n_body") - 1).cast("int").alias("after_idx"), F.coalesce(some("/tbl/tblPr/tblStyle/@val"), F.lit("")).alias("style"),
        F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).when(F.size(kinds) > 1, F.concat(F.lit("mixed:"), F.array_join(kinds, ","))).alias("border_style"), F.array_max(sizes).alias("border_size_pt"), *map(edge, ("top", "bottom", "left", "right")),
    )
    section = whole.select("path", F.posexplode(styles.elements(F.col("document"), "sectPr")).alias("section_no", "s"))
    inch = lambda p: F.round(F.xpath_double("s", F.lit(p)) / 1440, 3)
    # links and files are looked up before the pictures become rows, and worked out once for a package
    base = lambda x: F.substring_index(x, "/", -1)
    links = F.transform(styles.elements(F.coalesce("rels", F.lit("")), "Relationship"), lambda x: F.struct(styles.at(x, "/Relationship/@Id").alias("id"), base(styles.at(x, "/Relationship/@Target")).alias("name")))
    files = F.transform("media", lambda m: F.struct(base(m["name"]).alias("name"), m.alias("m")))

    def picture(d: Column, both: Column) -> Column:
        link = F.regexp_extract(d, r"<blip [^>]*?\bembed=\"([^\"]*)\"", 1)
        name = styles.first_of(both["links"], lambda x: x["id"] == link)["name"]
        extent = F.regexp_extract(d, r"<extent [^>]*/>", 0)
        inches = lambda side: (styles.at(extent, f"/extent/@{side}").cast("double") / EMU_PER_INCH)
        return F.struct(inches("cx").alias("in_w"), inches("cy").alias("in_h"), styles.first_of(both["files"], lambda x: x["name"] == name)["m"].alias("m"))

    drawings = F.regexp_extract_all("document", F.lit(r"(?s)<inline(?: [^>]*)?>.*?</inline>"), F.lit(0))
    pictures = F.get(F.transform(F.array(F.struct(links.alias("links"), files.alias("files"))), lambda both: F.transform(drawings, lambda d: picture(d, both))), F.lit(0))
    seen = whole.select("path", F.posexplode(pictures).alias("image_no", "i")).select("path", "image_no", "i.in_w", "i.in_h", "i.m")
    return {
        "paragraphs": paragraph_text(runs),
        "runs": runs,
        "para_format": formats,
        "cells": cells,
        "cell_runs": cell_runs,
        "tables": tables,
        "sections": section.select("path", "section_no", inch("/sectPr/pgSz/@w").alias("width_in"), inch("/sectPr/pgSz/@h").alias("height_in"), inch("/sectPr/pgMar/@left").alias("left_in"), inch("/sectPr/pgMar/@right").alias("right_in"), inch("/sectPr/pgMar/@top").alias("top_in"), inch("/sectPr/pgMar/@bottom").alias("bottom_in")),
        "images": seen.select("path", "image_no", "in_w", "in_h", "m.fmt", "m.px_w", "m.px_h", "m.kb"),
        "list_levels": whole.select("path", F.explode(styles.list_levels(F.coalesce("numbering", F.lit("<numbering/>")))).alias("v")).select("path", "v.*"),
        "parts": members(packages).select("path", "member"),
        "rels": members(packages).filter(F.col("member").endswith(".rels")).select("path", F.explode(F.xpath("xml", F.lit("//Relationship/@Target"))).alias("target")),
    }


def paragraph_text(runs: DataFrame, key: str = "path") -> DataFrame:
    """SRC-2b: (key, idx, text) from runs in order; adjacent superscript numbers behind a letter or punctuation become one `[45, 48]`."""
    order = Window.partitionBy(key, "idx").orderBy("run_no")
    number = F.coalesce("superscript", F.lit(False)) & F.col("text").rlike(r"^[\d,\s–-]+$")
    before = F.coalesce(F.lag("text").over(order), F.lit(""))
    marked = runs.withColumn("number", number)
    starts = F.col("number") & ~F.coalesce(F.lag("number").over(order), F.lit(False))
    grouped = marked.withColumn("before", before).withColumn("start", (starts | ~F.col("number")).cast("int")).withColumn("island", F.sum("start").over(order))
    island = grouped.groupBy(key, "idx", "island").agg(F.array_sort(F.collect_list(F.struct("run_no", "text", "number", "before"))).alias("rs"))
    joined = F.array_join(F.transform("rs", lambda x: x["text"]), "")
    head = F.element_at("rs", 1)
    cited = F.concat(F.lit("["), F.regexp_replace(F.trim(joined), r"\s*,\s*", ", "), F.lit("]"))
    piece = F.when(head["number"] & head["before"].rlike(r"[\p{L}.,;:)\]]\s*$"), cited).otherwise(joined)
    pieces = island.select(key, "idx", F.struct("island", piece.alias("piece")).alias("p")).groupBy(key, "idx").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return pieces.select(key, "idx", F.array_join(F.transform("ps", lambda x: x["piece"]), "").alias("text"))


def revisions_from_tracked(packages: DataFrame) -> DataFrame:
    """SRC-3: (path, idx, original, edited) from tracked changes: the original leaves insertions out, the edited text deletions."""
    para = _paragraph_xml(packages)
    original = xml.text_of(F.col("xml"), "t", "delText", outside="ins")
    edited = xml.text_of(F.col("xml"), "t", outside="del")
    return para.select("path", "idx", original.alias("original"), edited.alias("edited"))


def cells(cell_rows: DataFrame, net: str) -> DataFrame:
    """SRC-5: cells by net: prose (15 characters and 3 real words), readable (a word of 4 letters, equal texts of a table once), lettered (any letter)."""
    if net == "prose":
        return cell_rows.filter((F.length(F.trim("text")) >= 15) & (F.regexp_count("text", F.lit(r"\b[A-Za-z]{3,}\b")) >= 3))
    if net == "readable":
        some = cell_rows.filter(F.col("text").rlike("[A-Za-z]{4,}"))
        return some.groupBy("doc_id", "table_no", "text").agg(F.min(F.struct("row", "col")).alias("at")).select("doc_id", "table_no", "at.row", "at.col", "text")
    return cell_rows.filter(F.col("text").rlike(r"\p{L}"))
