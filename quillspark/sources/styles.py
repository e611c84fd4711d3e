"""Styles and numbering of a package: parent chains, list levels, and the numbers that a word processor prints.

The definitions of one package are arrays of its own row, so chains are followed
within the row and nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .xml import attribute as at
from .xml import let as _let

# How far a chain of parent styles is followed for fonts, and for a heading's level.
FONT_STEPS, HEADING_STEPS = 8, 5
# The house's names of number formats and bullets.
NUMBER_CODES = {"decimal": "N1", "lowerRoman": "N2", "lowerLetter": "N3"}
BULLET_CODES = {"": "B1", "•": "B1", "●": "B1", "∙": "B1", "": "B2", "○": "B2", "◦": "B2", "o": "B2", "": "B3", "■": "B3", "▪": "B3", "": "B4", "□": "B4", "▫": "B4"}
LEVELS = 9


def elements(xml: Column, tag: str) -> Column:
    """The elements of that name, for names that don't nest in themselves."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?: [^>]*)?/>|<{tag}(?: [^>]*)?>.*?</{tag}>"), F.lit(0))


def first_of(rows: Column, test) -> Column:
    return F.get(F.filter(rows, test), F.lit(0))


def heading_level(name: Column) -> Column:
    """The 0-based level that a style's name gives, or null."""
    return F.nullif(F.regexp_extract(F.trim(F.coalesce(name, F.lit(""))), r"(?i)^heading\s*([1-9])$", 1), F.lit("")).cast("int") - 1


def declared(xml: Column) -> Column:
    """A style sheet's styles as they stand: array of (id, kind, by_default, name, parent, font, size, num_id, num_level)."""
    return F.transform(
        elements(xml, "style"),
        lambda x: F.struct(
            at(x, "/style/@styleId").alias("id"), at(x, "/style/@type").alias("kind"), F.coalesce(at(x, "/style/@default").isin("1", "true"), F.lit(False)).alias("by_default"), at(x, "/style/name/@val").alias("name"), at(x, "/style/basedOn/@val").alias("parent"),
            at(x, "/style/rPr/rFonts/@ascii").alias("font"), (at(x, "/style/rPr/sz/@val").cast("double") / 2).alias("size"), at(x, "/style/pPr/numPr/numId/@val").alias("num_id"), at(x, "/style/pPr/numPr/ilvl/@val").cast("int").alias("num_level"),
        ),
    )


def resolved(styles: Column, default_font: Column, default_size: Column) -> Column:
    """The styles with what they inherit: the nearest value on the chain of parents, then the document's default.

    A chain is followed for FONT_STEPS styles, so a cycle ends too.  A heading's level
    comes from the nearest style named for one, HEADING_STEPS styles up at most.
    """

    def up(style: Column) -> Column:
        kinds = "struct<parent:string,font:string,size:double,level:int>"
        begin = F.struct(style["id"].alias("parent"), F.lit(None).cast("string").alias("font"), F.lit(None).cast("double").alias("size"), F.lit(None).cast("int").alias("level")).cast(kinds)

        def one(found: Column, step: Column) -> Column:
            take = lambda s: F.struct(s["parent"].alias("parent"), F.coalesce(found["font"], s["font"]).alias("font"), F.coalesce(found["size"], s["size"]).alias("size"), F.coalesce(found["level"], F.when(step < HEADING_STEPS, heading_level(s["name"]))).alias("level")).cast(kinds)
            return _let(first_of(styles, lambda s: s["id"] == found["parent"]), take)

        return F.aggregate(F.sequence(F.lit(0), F.lit(FONT_STEPS - 1)), begin, one)

    def whole(style: Column) -> Column:
        return _let(up(style), lambda u: F.struct(*[style[c].alias(c) for c in ("id", "kind", "by_default", "name", "num_id", "num_level")], F.coalesce(u["font"], default_font).alias("font"), F.coalesce(u["size"], default_size).alias("size"), u["level"].alias("level")))

    return F.transform(styles, whole)


def defaults(xml: Column) -> tuple[Column, Column]:
    """Font and size of the document's defaults."""
    font = F.coalesce(*[at(xml, f"/styles/docDefaults/rPrDefault/rPr/rFonts/@{a}") for a in ("ascii", "hAnsi", "cs")])
    size = at(xml, "/styles/docDefaults/rPrDefault/rPr/sz/@val")
    return font, F.when(size.rlike(r"^\d+$"), size.cast("double") / 2)


def list_levels(xml: Column) -> Column:
    """The levels of a package's lists: array of (num_id, level, start, num_fmt, lvl_text), through each list's abstract definition."""
    levels = lambda x: F.transform(elements(x, "lvl"), lambda v: F.struct(at(v, "/lvl/@ilvl").cast("int").alias("level"), F.coalesce(at(v, "/lvl/start/@val").cast("int"), F.lit(1)).alias("start"), at(v, "/lvl/numFmt/@val").alias("num_fmt"), at(v, "/lvl/lvlText/@val").alias("lvl_text")))
    abstract = F.transform(elements(xml, "abstractNum"), lambda x: F.struct(at(x, "/abstractNum/@abstractNumId").alias("id"), levels(x).alias("levels")))
    lists = F.transform(elements(xml, "num"), lambda x: F.struct(at(x, "/num/@numId").alias("num_id"), at(x, "/num/abstractNumId/@val").alias("abstract")))

    def of_list(n: Column, known: Column) -> Column:
        named = lambda d: F.transform(d["levels"], lambda v: F.struct(n["num_id"].alias("num_id"), *[v[c].alias(c) for c in ("level", "start", "num_fmt", "lvl_text")]))
        return _let(first_of(known, lambda d: d["id"] == n["abstract"]), lambda d: F.coalesce(named(d), F.array()))

    return _let(abstract, lambda known: F.flatten(F.transform(lists, lambda n: of_list(n, known))))


def listing(levels: Column, num_id: Column, level: Column) -> Column:
    """A list paragraph's marker: (num_id, level, kind, glyph, house_code, num_fmt, lvl_text, dot_suffix, start); null without a list."""
    codes = lambda table, x: F.coalesce(*[F.when(x == k, v) for k, v in table.items()])

    def marker(own: Column, v: Column) -> Column:
        fmt, text = v["num_fmt"], F.coalesce(v["lvl_text"], F.lit(""))
        bullet, number = F.coalesce(fmt == "bullet", F.lit(False)), F.coalesce(fmt != "bullet", F.lit(False))
        return F.struct(
            own["num_id"].alias("num_id"), own["level"].alias("level"), F.when(bullet, "bullet").when(number, "number").otherwise("unknown").alias("kind"), F.when(bullet, F.substring(text, 1, 1)).alias("glyph"),
            F.when(bullet, codes(BULLET_CODES, F.substring(text, 1, 1))).when(number, codes(NUMBER_CODES, fmt)).alias("house_code"), fmt.alias("num_fmt"), text.alias("lvl_text"), F.when(number, F.rtrim(text).endswith(".")).alias("dot_suffix"), v["start"].alias("start"),
        )

    def of_own(own: Column) -> Column:
        # a list of which nothing is known has a marker of kind `unknown`
        nothing = F.struct(own["num_id"].alias("num_id"), own["level"].alias("level"), F.lit(1).alias("start"), F.lit(None).cast("string").alias("num_fmt"), F.lit(None).cast("string").alias("lvl_text"))
        known = first_of(levels, lambda v: (v["num_id"] == own["num_id"]) & (v["level"] == own["level"]))
        return F.when(own["num_id"].isNotNull(), _let(F.coalesce(known, nothing), lambda v: marker(own, v)))

    return _let(F.struct(num_id.alias("num_id"), level.alias("level")), of_own)


def _roman(n: Column) -> Column:
    places = (("", "m", "mm", "mmm"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))
    digit = lambda k: F.floor(n / 10 ** (3 - k)).cast("int") % 10
    return F.concat(*[F.get(F.array(*map(F.lit, signs)), digit(k)) for k, signs in enumerate(places)])


def printed(n: Column, fmt: Column) -> Column:
    """A counter in a number format; letters repeat behind z, and what has no form here is decimal."""
    letter = F.repeat(F.char(97 + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))
    roman = F.when(n < 4000, _roman(n)).otherwise(n.cast("string"))
    return F.when(fmt == "lowerLetter", letter).when(fmt == "upperLetter", F.upper(letter)).when(fmt == "lowerRoman", roman).when(fmt == "upperRoman", F.upper(roman)).when(fmt == "decimalZero", F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def outline_numbers(formats: DataFrame, levels: DataFrame, key: str = "doc_id") -> DataFrame:
    """WN-16: (key, idx, level, label): the numbers that automatic numbering prints before list paragraphs.

    formats: (key, idx, listing); levels: (key, num_id, level, start, num_fmt,
    lvl_text) of all levels.  A paragraph counts up its own level, and a higher one
    starts all deeper levels anew: a level's count is its running count less what
    that was at the last higher paragraph, both from one sort of the list.
    """
    order = Window.partitionBy(key, "listing.num_id").orderBy("idx")
    listed = formats.filter("listing.kind = 'number'").select(key, "idx", "listing", F.col("listing.level").alias("level"))
    run = listed.select("*", *[F.count(F.when(F.col("level") == k, 1)).over(order).alias(f"n{k}") for k in range(LEVELS)])
    base = lambda k: F.coalesce(F.max(F.when(F.col("level") < k, F.col(f"n{k}"))).over(order), F.lit(0))
    counts = run.select(key, "idx", "listing", "level", *[(F.col(f"n{k}") - base(k)).alias(f"c{k}") for k in range(LEVELS)])
    per = levels.groupBy(key, "num_id").agg(F.collect_list(F.struct("level", "start", "num_fmt")).alias("known"))
    both = counts.withColumn("num_id", F.col("listing.num_id")).join(per, [key, "num_id"], "left")

    def shown(label: Column, k: int) -> Column:
        mark = first_of(F.coalesce("known", F.array()), lambda v: v["level"] == k)
        pattern = F.col("listing.lvl_text")
        # a percent sign before another may meet the number of that one
        named = F.contains(pattern, F.lit(f"%{k + 1}")) | F.contains(pattern, F.lit("%%"))
        text = F.when(named, _let(mark, lambda v: printed(F.greatest(F.col(f"c{k}"), F.lit(1)).cast("int") + F.coalesce(v["start"], F.lit(1)) - 1, F.coalesce(v["num_fmt"], F.lit("decimal"))))).otherwise("")
        return F.replace(label, F.lit(f"%{k + 1}"), text)

    return both.select(key, "idx", "level", reduce(shown, range(LEVELS), F.col("listing.lvl_text")).alias("label"))
