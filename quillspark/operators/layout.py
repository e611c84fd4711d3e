"""House layout over structure tables: runs, paragraph formats, tables, pages, images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.rewrites import SMALL_WORDS
from ..sources.corpus import zones

# The house's headings, page, table, body and image limits.
HEADINGS = {1: ("upper", True, None, "left"), 2: ("title", True, None, "left"), 3: ("title", True, True, "left"), 4: ("title", False, True, "left"), 5: ("sentence", False, True, None), 6: ("sentence", False, False, None)}
PAGE = {"width_in": 8.27, "height_in": 11.69, "left_in": 1.0, "right_in": 1.0, "top_in": 0.6, "bottom_in": 0.5}
PAGE_TOLERANCE = 0.02
BODY_FONT, BODY_SIZE, BODY_ALIGN, BODY_INDENT, BODY_SHARE, BODY_CHARS = "Times New Roman", 11.0, "justify", 0.15, 0.30, 120
ARTWORK = (9.0, 6.0)
# Words that stay small in a heading of capitalised words.
TITLE_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with", "into", "over", "vs")
BULLETS, NUMBERS = ("B1", "B2", "B3", "B4"), ("N1", "N2", "N3")


def case_of(text: Column) -> Column:
    """upper, sentence, title, mixed or unknown, judged on letters."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    words = F.filter(F.split(F.trim(text), r"[\s/–—-]+"), lambda w: w.rlike(r"\p{L}"))
    capped = lambda w: w.rlike(r"^[^\p{L}]*\p{Lu}")
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    lower = F.filter(rest, lambda w: ~capped(w))
    first = capped(F.element_at(words, 1))
    small = F.forall(lower, lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]", "")).isin(*SMALL_WORDS))
    return (
        F.when(letters == "", "unknown")
        .when(letters == F.upper(letters), "upper")
        .when(~first, "mixed")
        .when(F.size(rest) == F.size(lower), "sentence")
        .when(small, "title")
        .otherwise("mixed")
    )


PARAGRAPH = ("doc_id", "idx")


def dominant(runs: DataFrame, keys: Sequence[str] = PARAGRAPH) -> DataFrame:
    """AG-17: (keys, font, size): the font and size of most characters; ties go to the lesser name or size."""
    weigh = lambda c: runs.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.sum(F.length("text")).alias("n"))
    fonts, sizes = weigh("font_name"), weigh("font_size_pt")
    top = lambda df, c, name: df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), c))).filter("k = 1").select(*keys, F.col(c).alias(name))
    return top(fonts, "font_name", "font").join(top(sizes, "font_size_pt", "size"), [*keys], "full_outer")


def looks(runs: DataFrame, keys: Sequence[str] = PARAGRAPH) -> DataFrame:
    """(keys, font, size, bold, weights): dominant() and the bold of weight() of runs with visible text in one pass, and how many weights they have."""
    per = runs.groupBy(*keys).agg(F.collect_list(F.struct(F.col("font_name").alias("font"), F.col("font_size_pt").alias("size"), F.length("text").cast("bigint").alias("n"))).alias("rs"), F.collect_set("bold").alias("set"), F.count("bold").alias("told"), F.count("*").alias("all"))

    def top(c: str) -> Column:
        total = lambda v: F.aggregate(F.filter("rs", lambda r: r[c] == v), F.lit(0).cast("bigint"), lambda a, r: a + r["n"])
        values = F.array_compact(F.array_distinct(F.transform("rs", lambda r: r[c])))
        return F.when(F.size(values) > 1, F.array_min(F.transform(values, lambda v: F.struct((-total(v)).alias("n"), v.alias("v"))))["v"]).otherwise(F.get(values, F.lit(0)))

    false = F.array_contains("set", False) | (F.col("told") < F.col("all"))
    bold = F.when(F.col("told") > 0, ~false)
    weights = F.array_contains("set", True).cast("int") + false.cast("int")
    return per.select(*keys, top("font").alias("font"), top("size").alias("size"), bold.alias("bold"), weights.cast("bigint").alias("weights"))


def weight(runs: DataFrame, keys: Sequence[str] = PARAGRAPH) -> DataFrame:
    """AG-18: (keys, bold, italic) of visible text: null where no run states it, else true only if every run is."""
    some = runs.filter("trim(text) <> ''")
    three = lambda c: F.when(F.count(c) == 0, None).otherwise(F.bool_and(F.coalesce(c, F.lit(False)))).alias(c)
    return some.groupBy(*keys).agg(three("bold"), three("italic"))


def headings(formats: DataFrame, weights: DataFrame) -> DataFrame:
    """JN-29: (doc_id, idx, rule): headings against their level's specification.  formats: (doc_id, idx, text, outline_level, alignment)."""
    rows = [(n, *spec) for n, spec in HEADINGS.items()]
    spec = F.broadcast(formats.sparkSession.createDataFrame(rows, "level int, want_case string, want_bold boolean, want_italic boolean, want_align string"))
    both = formats.filter("outline_level IS NOT NULL").withColumn("level", F.col("outline_level") + 1).join(spec, "level").join(weights, ["doc_id", "idx"], "left")
    case = case_of(F.col("text"))
    bad = F.array(
        F.when((case != "unknown") & (case != F.col("want_case")), "heading.case"),
        F.when(F.col("bold") != F.col("want_bold"), "heading.bold"),
        F.when(F.col("italic") != F.col("want_italic"), "heading.italic"),
        F.when(F.col("alignment") != F.col("want_align"), "heading.alignment"),
    )
    return both.select("doc_id", "idx", F.explode(F.array_compact(bad)).alias("rule"))


def skipped_levels(formats: DataFrame) -> DataFrame:
    """WN-4: (doc_id, idx, level, before): headings more than one level below the heading before."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    level = formats.filter("outline_level IS NOT NULL").withColumn("level", F.col("outline_level") + 1).withColumn("before", F.lag("level").over(order))
    return level.filter("level > before + 1").select("doc_id", "idx", "level", "before")


def listings(formats: DataFrame) -> DataFrame:
    """WN-16: (doc_id, idx, rule): one finding for each list whose marks aren't the house's.  formats with `listing` struct."""
    order = Window.partitionBy("doc_id", "listing.num_id", "listing.level").orderBy("idx")
    rule = (
        F.when((F.col("listing.kind") == "bullet") & ~F.coalesce(F.col("listing.house_code").isin(*BULLETS), F.lit(False)), "listing.bullet")
        .when((F.col("listing.kind") == "number") & ~F.coalesce(F.col("listing.house_code").isin(*NUMBERS), F.lit(False)), "listing.number")
        .when((F.col("listing.kind") == "number") & ~F.col("listing.dot_suffix"), "listing.number-separator")
    )
    first = formats.filter("listing IS NOT NULL").withColumn("k", F.row_number().over(order)).filter("k = 1")
    return first.select("doc_id", "idx", rule.alias("rule")).filter("rule IS NOT NULL")


def auto_numbered(p: DataFrame, labels: DataFrame) -> DataFrame:
    """WN-16: (doc_id, idx, label): headings whose number isn't typed but made by list numbering: short lines in title or upper case without an end mark.  labels: (doc_id, idx, label)."""
    text = F.trim("text")
    words = F.split(text, r"\s+")
    titled = F.forall(F.filter(words, lambda w: w.rlike(r"^\p{L}")), lambda w: w.rlike(r"^\p{Lu}") | F.lower(w).isin(*TITLE_WORDS))
    like = (text != "") & (F.length(text) <= 70) & ~text.rlike(r"[.!?,;]$") & (F.size(words) <= 9) & (((text == F.upper(text)) & text.rlike(r"\p{L}")) | titled)
    return p.join(labels, ["doc_id", "idx"]).filter(like).select("doc_id", "idx", "label")


def page_geometry(sections: DataFrame) -> DataFrame:
    """JN-29: (doc_id, section_no, side, got): page sizes and margins off the house's by more than the tolerance."""
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).alias("got"), F.lit(v).alias("want")) for k, v in PAGE.items()]))
    return sections.select("doc_id", "section_no", sides.alias("s")).select("doc_id", "section_no", "s.side", "s.got", "s.want").filter(F.abs(F.col("got") - F.col("want")) > PAGE_TOLERANCE).drop("want")


def artwork(images: DataFrame) -> DataFrame:
    """JN-29: images over the greatest size."""
    return images.filter((F.col("in_w") > ARTWORK[0] + 0.01) | (F.col("in_h") > ARTWORK[1] + 0.01)).select("doc_id", "image_no", F.lit("artwork.size").alias("rule"))


def table_captions(tables: DataFrame, p: DataFrame) -> DataFrame:
    """JN-11: (doc_id, table_no, rule): tables without a caption line right above, or with one that no other paragraph cites.  tables: (doc_id, table_no, after_idx)."""
    above = tables.join(p.select("doc_id", F.col("idx").alias("after_idx"), "text"), ["doc_id", "after_idx"], "left")
    label = F.coalesce(F.col("text").rlike(r"(?i)^\s*table\s*(?:\d+|[ivxlc]+\b)"), F.lit(False))
    none = above.filter(~label).select("doc_id", "table_no", F.lit("table.caption").alias("rule"))
    numbered = above.filter(label).withColumn("n", F.regexp_extract("text", r"(?i)^\s*table\s*(\d+)", 1)).filter("n <> ''")
    cited = p.select("doc_id", "idx", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)\btable\s*(\d+)\b"), F.lit(1))).alias("n"))
    c = cited.withColumnsRenamed({"doc_id": "d", "n": "m"})
    silent = numbered.join(c, (F.col("doc_id") == F.col("d")) & (F.col("n") == F.col("m")) & (F.col("idx") != F.col("after_idx")), "left_anti").select("doc_id", "table_no", F.lit("table.not-cited").alias("rule"))
    return none.union(silent)


def table_notes(tables: DataFrame, formats: DataFrame, size: float = 9.0) -> DataFrame:
    """JN-12: (doc_id, table_no, idx): note lines among the first three paragraphs below a table that aren't in the note size."""
    below = formats.join(tables.withColumnRenamed("doc_id", "d"), (F.col("doc_id") == F.col("d")) & (F.col("idx") > F.col("after_idx")) & (F.col("idx") <= F.col("after_idx") + 3))
    return below.filter(F.col("text").rlike(r"(?i)^\s*(note|source)s?\b\s*[:.]") & (F.abs(F.col("size") - size) > 0.01)).select("doc_id", "table_no", "idx")


def body_text(p: DataFrame, formats: DataFrame, looks: DataFrame) -> DataFrame:
    """AG-19: (doc_id, rule, bad, total, first): body deviations of at least the share of a document's body paragraphs."""
    z = zones(p).filter("zone = 'body'").select("doc_id", "idx", "text")
    body = z.join(formats.select("doc_id", "idx", "outline_level", "alignment", "listing", "first_line_in"), ["doc_id", "idx"]).join(looks, ["doc_id", "idx"], "left").filter((F.length(F.trim("text")) >= BODY_CHARS) & F.col("outline_level").isNull() & F.col("listing").isNull())
    flags = F.explode(
        F.array(
            F.struct(F.lit("body.font").alias("rule"), F.coalesce(F.col("font") != BODY_FONT, F.lit(False)).alias("bad")),
            F.struct(F.lit("body.size").alias("rule"), F.coalesce(F.abs(F.col("size") - BODY_SIZE) > 0.01, F.lit(False)).alias("bad")),
            F.struct(F.lit("body.alignment").alias("rule"), F.coalesce(F.col("alignment") != BODY_ALIGN, F.lit(False)).alias("bad")),
            F.struct(F.lit("body.first-line-indent").alias("rule"), (F.col("first_line_in").isNull() | (F.abs(F.col("first_line_in") - BODY_INDENT) > 0.01)).alias("bad")),
        )
    )
    each = body.select("doc_id", "idx", flags.alias("f"))
    per = each.groupBy("doc_id", "f.rule").agg(F.count(F.when(F.col("f.bad"), 1)).alias("bad"), F.count("*").alias("total"), F.min(F.when(F.col("f.bad"), F.col("idx"))).alias("first"))
    return per.filter(F.col("bad") / F.col("total") >= BODY_SHARE)


def reference_layout(refs: DataFrame, formats: DataFrame, looks: DataFrame) -> DataFrame:
    """AG-20: (doc_id, rule): lists of which under half the entries are numbered or hang, or of which 0.30 are in another size."""
    both = refs.join(formats.select("doc_id", "idx", "first_line_in"), ["doc_id", "idx"], "left").join(looks, ["doc_id", "idx"], "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    per = both.groupBy("doc_id").agg(share(F.col("text").rlike(r"^\s*\[?\d{1,3}[\].)]")).alias("numbered"), share(F.col("first_line_in") < 0).alias("hanging"), share(F.abs(F.col("size") - BODY_SIZE) > 0.01).alias("sized"))
    rules = F.array_compact(F.array(F.when(F.col("numbered") < 0.5, "references.numbering"), F.when(F.col("hanging") < 0.5, "references.hanging"), F.when(F.col("sized") >= BODY_SHARE, "references.size")))
    return per.select("doc_id", F.explode(rules).alias("rule"))


def front_matter(p: DataFrame, looks: DataFrame) -> DataFrame:
    """AG-21: (doc_id, rule): title, authors, abstract and keywords that a document lacks; a title in another size."""
    z = zones(p)
    has = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    found = z.filter("zone IN ('front', 'abstract')").groupBy("doc_id").agg(has((F.col("idx") == 0) & (F.trim("text") != "")).alias("title"), has(P.is_byline(F.col("text")) & (F.col("idx") > 0)).alias("authors"), has(F.col("zone") == "abstract").alias("abstract"), has(F.col("text").rlike(r"(?i)^\s*key\s?[-‐-―]?\s?words?\b")).alias("keywords"))
    parts = ("title", "authors", "abstract", "keywords")
    lacks = found.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(~F.col(x), f"front.{x}-missing") for x in parts]))).alias("rule"))
    small = p.filter("idx = 0").select("doc_id", "idx").join(looks, ["doc_id", "idx"]).filter(F.abs(F.col("size") - 20.0) > 0.01).select("doc_id", F.lit("front.title-size").alias("rule"))
    return lacks.union(small)


def table_cell_rollup(cells: DataFrame) -> DataFrame:
    """AG-22: (doc_id, table_no, sizes, bold_share): a table's cell sizes and share of bold cells, one row for each table with several sizes.  cells with size and bold."""
    per = cells.groupBy("doc_id", "table_no").agg(F.array_sort(F.collect_set("size")).alias("sizes"), F.avg(F.coalesce("bold", F.lit(False)).cast("int")).alias("bold_share"))
    return per.filter("size(sizes) > 1").select("doc_id", "table_no", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"), "bold_share")


def collapse_layout(findings: DataFrame) -> DataFrame:
    """AG-23: (doc_id, rule, key, n, first_idx, message): messages that differ in a table, section or character number alone are one, with their count."""
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace("message", r"\btable \d+\b", "table N"), r"\bsection \d+\b", "section N"), r"\(\d+ characters\)", "(N characters)")
    return findings.groupBy("doc_id", "rule", key.alias("key")).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.min_by("message", F.struct("idx", "message")).alias("message"))


def missing_parts(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """AG-30: (doc_id, media): media files that no relationship of the document points at.  parts: (doc_id, member); rels: (doc_id, target)."""
    media = parts.filter(F.col("member").startswith("word/media/")).select("doc_id", F.col("member").alias("media"), F.substring_index("member", "/", -1).alias("name"))
    return media.join(rels.select("doc_id", F.substring_index("target", "/", -1).alias("name")), ["doc_id", "name"], "left_anti").select("doc_id", "media")
