"""Bibliographies: entries, gaps, parsing, duplicates, completion, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.wordlists import CENSUS_LABELS
from ..sources.corpus import zones
from ..sources.sinks import written
from .scans import citation_numbers, citation_slots

NOT_AN_ARTICLE = r"(?i)\b(thesis|dissertation|patent|standard|conference|proceedings|symposium|available (?:from|at)|press|publisher|edition|eds?\.|isbn)\b|https?://"
ENTRY_START = r"^\s*(?:\[\d{1,3}\]|\d{1,3}[.)])"


def reference_lines(p: DataFrame) -> DataFrame:
    """Paragraphs behind the References heading, without it and without blanks."""
    z = zones(p).filter("zone = 'references'")
    return z.filter(~P.folded_heading(F.col("text")).rlike("^(list of )?references?$|^bibliography$") & (F.trim("text") != "")).select("doc_id", "idx", F.trim("text").alias("text"))


def group_entries(lines: DataFrame) -> DataFrame:
    """WN-2: (doc_id, ref_no, idx, text): wrapped lines joined to entries where at least three lines are numbered, else one entry a line."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    start = F.col("text").rlike(ENTRY_START).cast("int")
    marked = lines.withColumn("start", start).withColumn("numbered", F.sum("start").over(Window.partitionBy("doc_id")) >= 3)
    placed = marked.withColumn("ref_no", F.when(F.col("numbered"), F.sum("start").over(order)).otherwise(F.row_number().over(order)).cast("int")).filter("ref_no > 0")
    joined = placed.groupBy("doc_id", "ref_no").agg(F.min("idx").alias("idx"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("parts"))
    return joined.select("doc_id", "ref_no", "idx", F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"))


def identity(text: Column) -> Column:
    """struct(surname, year) of an entry; null without both."""
    surname = F.regexp_extract(text, r"^\s*(?:\[?\d{1,3}[\].)]{0,2}\s*)?([A-Za-zÀ-ÿ'’-]{2,})", 1)
    year = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)
    return F.when((surname != "") & (year != ""), F.struct(F.lower(surname).alias("surname"), year.alias("year")))


def bibliography_census(refs: DataFrame) -> DataFrame:
    """AG-10: (doc_id, surname, year, n)."""
    known = refs.withColumn("who", identity(F.col("text"))).filter("who IS NOT NULL")
    return known.groupBy("doc_id", "who.surname", "who.year").agg(F.count("*").alias("n"))


def caption_census(p: DataFrame) -> DataFrame:
    """AG-11: (doc_id, kind, number, n)."""
    pattern = rf"(?i)^\s*({'|'.join(CENSUS_LABELS)})[.\s]*[:–-]?\s*(\d+)"
    word = F.lower(F.regexp_extract("text", pattern, 1))
    kind = F.when(word.isin("fig", "figure"), "figure").when(word.isin("eq", "equation"), "equation").otherwise(word)
    found = p.filter(F.col("text").rlike(pattern)).select("doc_id", kind.alias("kind"), F.regexp_extract("text", pattern, 2).alias("number"))
    return found.groupBy("doc_id", "kind", "number").agg(F.count("*").alias("n"))


def census_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """SO-1: (keys, change, times): multiset difference of two censuses with a count n, both ways."""
    left = before.groupBy(*keys).agg(F.sum("n").alias("a"))
    right = after.groupBy(*keys).agg(F.sum("n").alias("b"))
    gap = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    both = left.join(right, keys, "full_outer").withColumn("gap", gap).filter("gap <> 0")
    return both.select(*keys, F.when(F.col("gap") > 0, "lost").otherwise("surplus").alias("change"), F.abs("gap").alias("times"))


def missing_fields(text: Column) -> Column:
    """RF-1: the parts that an entry lacks: authors, year, volume/issue, pages."""
    authors = text.rlike(r"[A-Z][a-z'’-]+,?\s+(?:[A-Z]\.?\s*){1,4}") | text.rlike(r"(?i)\bet\s+al\b")
    article = ~text.rlike(NOT_AN_ARTICLE) & ~text.rlike(r"10\.\d{4,9}/")
    volume = text.rlike(r"\b\d{1,4}\s*\(\s*\d{1,4}[a-z]?\s*\)|;\s*\d{1,4}\s*[:(]|(?i)\bvol\.?\s*\d")
    pages = text.rlike(rf"\b\d{{1,5}}\s*{P.DASH}\s*\d{{1,5}}|(?i)\bpp?\.?\s*\d|:\s*e?\d{{1,6}}\b")
    lacks = [F.when(~authors, "authors"), F.when(~text.rlike(P.YEAR), "year"), F.when(article & ~volume, "volume/issue"), F.when(article & ~pages, "pages")]
    return F.array_compact(F.array(*lacks))


def lacks_title(text: Column) -> Column:
    """RF-1: whether no part of an entry says what the work is: three words of three letters or more, other than a year, an address or a note of access."""
    parts = F.transform(F.split(F.trim(text), r"(?<![A-Z])\.\s+(?=[A-Z\"'“])"), lambda s: F.regexp_replace(s, r"^[ .]+|[ .]+$", ""))
    word = r"[A-Za-z][A-Za-z'-]{2,}"
    tells = lambda s: ~s.rlike(rf"^(?:{P.YEAR})$|(?i)https?://|www\.|^(?:available|accessed|retrieved|cited|online|doi)\b") & (F.regexp_count(s, F.lit(word)) >= 3)
    return ~F.exists(parts, tells)


def lacks_chapter_pages(text: Column) -> Column:
    """RF-1: whether an entry in an edited book gives no page range."""
    return text.rlike(r"(?i)\bin\s*:|\b(?:editors?|eds?\.)(?![A-Za-z])") & ~text.rlike(r"\d\s*[-–—]\s*\d")


#: What makes a line a citation: a year from 1800 on, an identifier or address, pages, a volume, further authors.
CITES = (r"\b(?:1[89]|20)\d\d\b", r"\b10\.\d{4,9}/", r"(?i)https?://|www\.", P.SIGNALS["pages"], P.SIGNALS["volume"], P.SIGNALS["more authors"])


def incomplete_refs(refs: DataFrame) -> DataFrame:
    """RF-1: (doc_id, ref_no, idx, missing) of entries with gaps: a title, authors, year, volume/issue, pages, a chapter's pages; fragments and lines without a citation signal are passed over."""
    t = F.col("text")
    real = (F.length(t) >= 30) & ((F.length(t) >= 120) | t.rlike(P.YEAR)) & P.any_of(t, *CITES)
    lacks = F.concat(F.array_compact(F.array(F.when(lacks_title(t), "title"))), missing_fields(t), F.array_compact(F.array(F.when(lacks_chapter_pages(t), "chapter page range"))))
    return refs.filter(real).withColumn("missing", lacks).filter(F.size("missing") > 0).select("doc_id", "ref_no", "idx", "missing")


def mark_gaps(refs: DataFrame) -> DataFrame:
    """RW-14: refs with a marker for each missing field: authors at the head, the rest before the final stop."""
    gaps = F.array_except(missing_fields(F.col("text")), F.array(F.lit("authors")))
    number = F.regexp_extract("text", r"^\s*\[?\d{1,3}[\].)]{0,2}\s*", 0)
    body = F.substr("text", F.length(number) + 1)
    head = F.when(F.array_contains(missing_fields(F.col("text")), "authors"), F.concat(number, F.lit("[authors missing] "), body)).otherwise(F.col("text"))
    tail = F.concat(F.regexp_replace(head, r"\.\s*$", ""), F.lit(" ["), F.array_join(gaps, ", "), F.lit(" missing]."))
    return refs.withColumn("text", F.when(F.size(gaps) > 0, tail).otherwise(head))


def parse_refs(refs: DataFrame) -> DataFrame:
    """RF-2: (doc_id, ref_no, kind, authors, title, source, year, volume, issue, pages, doi): journal, chapter, book or other."""
    body = F.regexp_replace("text", r"^\s*\[?\d{1,3}[\].)]{0,2}\s*", "")
    parts = F.split(body, r"\.\s+")
    journal = r"((?:19|20)\d{2})\s*;\s*(\d{1,4})\s*(?:\(([^)]*)\))?\s*:\s*(\w+\s*[-–]?\s*\w*)"
    kind = F.when(body.rlike(journal), "journal").when(body.rlike(r"(?i)\bin:\s"), "chapter").when(body.rlike(r"(?i)\b(press|publisher|edition|isbn)\b|:\s*[A-Z][\w ]+;\s*(?:19|20)\d{2}"), "book").otherwise("other")
    pick = lambda g: F.nullif(F.regexp_extract(body, journal, g), F.lit(""))
    return refs.select(
        "doc_id", "ref_no", kind.alias("kind"), F.get(parts, 0).alias("authors"), F.get(parts, 1).alias("title"), F.get(parts, 2).alias("source"),
        F.coalesce(pick(1), F.nullif(F.regexp_extract(body, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))).alias("year"), pick(2).alias("volume"), pick(3).alias("issue"), pick(4).alias("pages"),
        F.nullif(F.regexp_extract(body, r"(10\.\d{4,9}/[^\s.]+)", 1), F.lit("")).alias("doi"),
    )


def duplicate_refs(refs: DataFrame, least: int = 30) -> DataFrame:
    """WN-3: (doc_id, ref_no, first_ref): entries whose words repeat an earlier entry's, marker and punctuation aside."""
    key = F.trim(F.regexp_replace(F.lower(F.regexp_replace("text", r"^\s*\[?\d{1,3}[\].)]{0,2}\s*", "")), "[^a-z0-9]+", " "))
    order = Window.partitionBy("doc_id", "key").orderBy("ref_no")
    keyed = refs.withColumn("key", key).filter(F.length("key") >= least)
    return keyed.withColumn("k", F.row_number().over(order)).withColumn("first_ref", F.first("ref_no").over(order)).filter("k > 1").select("doc_id", "ref_no", "first_ref")


def journal_style(refs: DataFrame) -> DataFrame:
    """AG-15: (doc_id, ref_no, journal): journal names in full, in lists of four or more that abbreviate others."""
    journal = F.trim(F.regexp_extract("text", r"\.\s+([^.]+)\.\s+(?:[A-Z][a-z]+ )?(?:19|20)\d{2}\s*;", 1))
    each = refs.filter(P.is_reference_block(F.col("text")) & (F.length("text") > 60)).withColumn("journal", journal)
    words = F.split("journal", r"\s+")
    joiners = F.size(F.filter(words, lambda w: F.lower(w).isin(*P.STOPWORDS)))
    short = (joiners == 0) & (F.size(words) <= 5) & F.forall(words, lambda w: F.length(w) <= 12)
    style = F.when(F.length("journal") < 4, None).when(short, "short").when((joiners >= 1) | (F.size(words) >= 5), "full")
    doc = Window.partitionBy("doc_id")
    counted = each.withColumn("style", style).withColumn("n", F.count("*").over(doc)).withColumn("shorts", F.count(F.when(F.col("style") == "short", 1)).over(doc))
    return counted.filter("n >= 4 AND shorts > 0 AND style = 'full'").select("doc_id", "ref_no", "journal")


def title_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))


def complete_references(refs: DataFrame, works: DataFrame, threshold: float = 0.75, per_doc: int = 15) -> DataFrame:
    """JN-16: (doc_id, ref_no, doi, score, entry): incomplete entries filled from the work of the same surname and year that shares
    at least `threshold` of its title words; the best work for each entry, `per_doc` entries a document (a lookup budget).

    works: (doi, title, authors, journal, year, volume, issue, pages).
    """
    gaps = incomplete_refs(refs).select("doc_id", "ref_no")
    order = Window.partitionBy("doc_id").orderBy("ref_no")
    wanted = refs.join(gaps, ["doc_id", "ref_no"]).withColumn("who", identity(F.col("text"))).filter("who IS NOT NULL").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_doc)
    known = works.withColumn("surname", F.lower(F.regexp_extract("authors", r"^([A-Za-zÀ-ÿ'’-]{2,})", 1))).withColumn("words", title_words(F.col("title")))
    both = wanted.select("doc_id", "ref_no", "text", F.col("who.surname").alias("surname"), F.col("who.year").alias("year")).join(known, ["surname", "year"])
    score = F.size(F.array_intersect("words", title_words(F.col("text")))) / F.size("words")
    best = Window.partitionBy("doc_id", "ref_no").orderBy(F.desc("score"), "doi")
    scored = both.filter(F.size("words") > 0).withColumn("score", score).filter(F.col("score") >= threshold).withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    entry = F.concat(F.col("authors"), F.lit(". "), F.col("title"), F.lit(". "), F.col("journal"), F.lit(". "), F.col("year"), F.lit(";"), F.col("volume"), F.lit("("), F.col("issue"), F.lit("):"), F.col("pages"), F.lit(". https://doi.org/"), F.col("doi"))
    return scored.select("doc_id", "ref_no", "doi", F.round("score", 6).alias("score"), entry.alias("entry"))


def clean_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def squeezed(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


#: Hundredths of a title's words that an entry shares at least, and of a title that needn't stand in the entry word for word.
SHARED, SURE = 55, 85
#: Characters of a title, or entry, that a second source goes by; and of the pieces by which such pairs meet.
HEAD, PIECE = 30, 12


def title_candidates(refs: DataFrame, works: DataFrame, share: int = SHARED) -> DataFrame:
    """(doc_id, ref_no, doi): all pairs of an entry and a work of whose title words the entry has `share` hundredths or more, and some others.

    A set-similarity join with a prefix filter: of k title words at least
    ceil(share * k / 100) must be shared, so one of the k - that + 1 rarest is.  Only
    those are joined, and words that most titles have stay out of the join.
    """
    each = works.select("doi", F.explode(title_words(F.col("title"))).alias("word"))
    ranked = each.join(each.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("doi").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ws"))
    k = F.size("ws")
    index = ranked.select("doi", F.explode(F.slice("ws", 1, k - F.floor((share * k + 99) / 100).cast("int") + 1)).alias("w")).select("doi", "w.word")
    asked = refs.select("doc_id", "ref_no", F.explode(title_words(F.col("text"))).alias("word"))
    return asked.join(index, "word").select("doc_id", "ref_no", "doi").distinct()


def head_candidates(refs: DataFrame, works: DataFrame) -> DataFrame:
    """(doc_id, ref_no, doi): pairs in which the head of the title stands in the entry, or the entry's head in the title, spaces and marks aside.

    Heads meet what contains them on their first PIECE characters; shorter titles name no work.
    """
    cut = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - PIECE + 1), lambda i: F.substr(c, i, F.lit(PIECE))))
    long = lambda df, c: df.filter(F.length(c) >= PIECE)
    entries = long(refs.select("doc_id", "ref_no", squeezed(F.col("text")).alias("entry")), "entry")
    titles = long(works.select("doi", squeezed(F.col("title")).alias("title")), "title")
    first = lambda df, c: df.withColumn("piece", F.left(c, F.lit(PIECE)))
    every = lambda df, c: df.withColumn("piece", F.explode(cut(c)))
    inside = lambda whole, part: F.contains(whole, F.left(part, F.lit(HEAD)))
    of_titles = every(entries, "entry").join(first(titles, "title"), "piece").filter(inside(F.col("entry"), F.col("title")))
    of_entries = first(entries, "entry").join(every(titles, "title"), "piece").filter(inside(F.col("title"), F.col("entry")))
    return of_titles.select("doc_id", "ref_no", "doi").union(of_entries.select("doc_id", "ref_no", "doi")).distinct()


def fill_dois(refs: DataFrame, works: DataFrame, secondary: DataFrame | None = None) -> DataFrame:
    """JN-17: (doc_id, ref_no, doi, score, source) of entries without a DOI.

    score: hundredths of the work's title words that the entry has.  Over SHARED, and
    with the whole title in the entry or SURE, the best work gives its DOI; a review
    only to an entry that says so.  Else the secondary catalogue does, by titles'
    heads and without a score.  works: (doi, title) and perhaps type.

    The entries and the works' hits are written once, as tables of the shared folder.
    """
    without = written(refs.filter(~F.col("text").rlike(r"10\.\d{4,9}/")).select("doc_id", "ref_no", "text"), "entries", plain=True)
    kind = F.lower(F.coalesce("type", F.lit(""))) if "type" in works.columns else F.lit("")
    # words and letters of entries and titles once each, before they meet in pairs
    entries = without.select("doc_id", "ref_no", title_words(F.col("text")).alias("has"), squeezed(F.col("text")).alias("entry"), F.contains(F.lower("text"), F.lit("review")).alias("told"))
    known = works.select("doi", title_words(F.col("title")).alias("words"), squeezed(F.col("title")).alias("whole"), F.contains(kind, F.lit("review")).alias("review"))
    both = title_candidates(without, works).join(entries, ["doc_id", "ref_no"]).join(known, "doi")
    score = F.round(100 * F.size(F.array_intersect("words", "has")) / F.size("words"), 6)
    fit = both.withColumn("score", score).filter((F.col("score") > SHARED) & (F.contains("entry", "whole") | (F.col("score") >= SURE)) & ~(F.col("review") & ~F.col("told")))
    found = fit.groupBy("doc_id", "ref_no").agg(F.min_by(F.struct("doi", "score"), F.struct(-F.col("score"), F.col("doi"))).alias("best")).select("doc_id", "ref_no", "best.doi", "best.score", F.lit("works").alias("source"))
    if secondary is None:
        return found
    found = written(found, "dois", plain=True)
    rest = without.join(found, ["doc_id", "ref_no"], "left_anti")
    other = head_candidates(rest, secondary).groupBy("doc_id", "ref_no").agg(F.min("doi").alias("doi"))
    return found.unionByName(other.select("doc_id", "ref_no", "doi", F.lit(None).cast("double").alias("score"), F.lit("secondary").alias("source")))


def book_places(refs: DataFrame, books: DataFrame) -> DataFrame:
    """JN-18: (doc_id, ref_no, place): the place of a book whose title and publisher the entry gives and whose place it doesn't.

    books: (title, publishers, places).
    """
    title = clean_title(F.element_at(F.split(F.regexp_replace("text", r"^\s*\[?\d{1,3}[\].)]{0,2}\s*", ""), r"\.\s+"), 2))
    both = refs.withColumn("key", title).join(books.withColumn("key", clean_title(F.col("title"))).withColumn("place", F.element_at("places", 1)), "key")
    named = F.exists("publishers", lambda x: F.contains(F.lower("text"), F.lower(x)))
    return both.filter(named & ~F.contains(F.lower("text"), F.lower("place"))).select("doc_id", "ref_no", "place").distinct()


def renumber(p: DataFrame, refs: DataFrame) -> DataFrame:
    """WN-8: (doc_id, ref_no, new_no): entries numbered by the order in which the text first cites them, uncited ones behind in list order."""
    cited = citation_numbers(p.join(refs.select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_anti"))
    first = cited.groupBy("doc_id", F.col("n").cast("int").alias("ref_no")).agg(F.min(F.struct("idx", "group", "n")).alias("place"))
    both = refs.select("doc_id", "ref_no").join(first, ["doc_id", "ref_no"], "left")
    order = Window.partitionBy("doc_id").orderBy(F.col("place").isNull(), "place", "ref_no")
    return both.select("doc_id", "ref_no", F.row_number().over(order).alias("new_no"))


def number_citations(p: DataFrame, refs: DataFrame) -> DataFrame:
    """JN-14: (doc_id, idx, slot_no, ref_no): author-date citations of which exactly one entry has the surname and year."""
    numbered = refs.withColumn("who", identity(F.col("text"))).filter("who IS NOT NULL").groupBy("doc_id", F.col("who.surname").alias("surname"), F.col("who.year").alias("year"))
    one = numbered.agg(F.min("ref_no").alias("ref_no"), F.count_distinct("ref_no").alias("n")).filter("n = 1").drop("n")
    slots = citation_slots(p).filter("kind = 'author-date'").withColumn("surname", F.lower("surname"))
    return slots.join(one, ["doc_id", "surname", "year"]).select("doc_id", "idx", "slot_no", "ref_no")


def citation_counts(p: DataFrame, refs: DataFrame) -> DataFrame:
    """RF-4: (doc_id, ref_no, cited): how many markers of the text name each entry, 0 for uncited ones."""
    cited = citation_numbers(p.join(refs.select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_anti")).select("doc_id", F.col("n").cast("int").alias("ref_no"))
    n = cited.groupBy("doc_id", "ref_no").agg(F.count("*").alias("cited"))
    return refs.select("doc_id", "ref_no").join(n, ["doc_id", "ref_no"], "left").select("doc_id", "ref_no", F.coalesce("cited", F.lit(0)).alias("cited"))


#: A caption's label with what parts it from the caption, a line of keywords, a heading's number, a citation by numbers, and marks at an author's name.
LABEL = r"(?i)^\s*((?:fig(?:ure)?|tab(?:le)?)\s*\.?\s*\d{1,2})[\s.:)–—-]*"
KEYWORDS = r"(?i)^\s*key\s*words?\s*[:–-]\s*(.+)$"
NUMBER = r"^(\d{1,2}(?:\.\d{1,2})*)\.?\s+"
MARKER = r"\[\d+(?:\s*[,–-]\s*\d+)*\]"
NAME_MARKS = r"[0-9*†‡§¶#]+"


def article_tables(p: DataFrame) -> DataFrame:
    """RF-3: (doc_id, idx, kind, section, heading, label, depth, content, items, xrefs): what each paragraph is in an article, and its parts.

    kind: title (the first paragraph with text), byline and affiliation (behind it),
    keywords, heading, abstract, caption, reference or text.  One name alone is a byline
    only before an affiliation.  section and heading: the number and text of the last
    heading.  label: a heading's number, whose parts are its depth, or a caption's
    figure or table; content: the paragraph without it.  items: a byline's authors, or the
    keywords.  xrefs: the numbers that text and captions cite, if the list has such entries.
    """
    t = F.trim("text")
    filled = t != ""
    listed = F.col("zone") == "references"
    title_of_list = P.folded_heading(F.col("text")).rlike("^(list of )?references?$|^bibliography$")
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("idx")
    entry = listed & filled & ~title_of_list
    names = F.filter(F.transform(F.split(t, r"\s*(?:,|;|\band\b|&)\s*"), lambda x: F.trim(F.regexp_replace(x, NAME_MARKS, ""))), lambda x: x != "")
    place = F.when(filled, F.dense_rank().over(Window.partitionBy("doc_id", filled).orderBy("idx")))
    # by document: the byline and affiliation that the second and third paragraphs with text may be, and the list's entries as group_entries() numbers them
    at = lambda k, what: F.coalesce(F.max(F.when(F.col("place") == k, what)).over(doc), F.lit(False))
    starts, lines = (F.count(F.when(entry & c, 1)).over(doc) for c in (F.col("text").rlike(ENTRY_START), F.lit(True)))
    z = zones(p).withColumn("place", place)
    z = z.withColumns({"affiliated": at(3, P.is_affiliation(F.col("text"))), "several": at(2, P.is_byline(F.col("text")) & (F.size(names) > 1)), "single": at(2, P.is_byline(F.col("text")) & ~P.is_heading(F.col("text"))), "n_entries": F.when(starts >= 3, starts).otherwise(lines)})
    signed = F.col("several") | (F.col("single") & F.col("affiliated"))
    front = F.when(F.col("place") == 1, "title").when((F.col("place") == 2) & signed, "byline").when((F.col("place") == 3) & signed & F.col("affiliated"), "affiliation")
    z = z.withColumn("front", F.when(~listed, front))
    words = F.col("front").isNull() & ~listed & F.col("text").rlike(KEYWORDS)
    head = F.col("front").isNull() & F.when(listed, title_of_list).otherwise(P.is_heading(F.col("text")))
    z = z.withColumns({"is_words": words & (F.col("idx") == F.min(F.when(words, F.col("idx"))).over(doc)), "is_head": head})
    z = z.withColumns({"section": F.sum(F.when(F.col("is_head"), 1).otherwise(0)).over(order).cast("int"), "heading": F.last(F.when(F.col("is_head"), t), True).over(order)})
    z = z.withColumn("in_abstract", F.col("section") == F.min(F.when(F.col("is_head") & (P.folded_heading(F.col("text")) == "abstract"), F.col("section"))).over(doc))
    caption = P.is_caption(F.col("text"), "Figure") | P.is_caption(F.col("text"), "Table")
    kind = F.coalesce("front", F.when(F.col("is_words"), "keywords").when(F.col("is_head"), "heading").when(listed, "reference").when(F.col("in_abstract") & filled, "abstract").when(caption, "caption").otherwise("text"))
    z = z.withColumn("kind", kind)
    is_kind = lambda *kinds: F.col("kind").isin(*kinds)
    number, label = F.nullif(F.regexp_extract(t, NUMBER, 1), F.lit("")), F.regexp_replace(F.regexp_extract("text", LABEL, 1), r"\s+", " ")
    content = F.when(is_kind("heading"), F.regexp_replace(t, NUMBER, "")).when(is_kind("caption"), F.trim(F.regexp_replace("text", LABEL, ""))).when(is_kind("keywords"), F.trim(F.regexp_extract("text", KEYWORDS, 1))).otherwise(t)
    keywords = F.filter(F.transform(F.split(F.regexp_extract("text", KEYWORDS, 1), "[;,]"), lambda x: F.regexp_replace(x, r"^[ .]+|[ .]+$", "")), lambda x: x != "")
    cited = F.regexp_extract_all(F.array_join(F.regexp_extract_all("text", F.lit(MARKER), F.lit(0)), " "), F.lit(r"\d+"), F.lit(0))
    xrefs = F.filter(F.transform(cited, lambda x: x.try_cast("bigint")), lambda n: n.between(1, F.col("n_entries")))
    return z.select(
        "doc_id", "idx", "kind", "section", "heading", F.when(is_kind("heading"), number).when(is_kind("caption"), label).alias("label"),
        F.when(is_kind("heading"), F.coalesce(F.size(F.split(number, r"\.")), F.lit(1))).alias("depth"), content.alias("content"),
        F.when(is_kind("byline"), names).when(is_kind("keywords"), keywords).alias("items"), F.when(is_kind("text", "caption"), xrefs).alias("xrefs"),
    )


def validate_article(p: DataFrame, refs: DataFrame) -> DataFrame:
    """JN-15: (doc_id, issue, n): numbers cited that no entry has; documents without a body or a reference list."""
    cited = citation_numbers(p.join(refs.select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_anti")).select("doc_id", F.col("n").cast("int").alias("ref_no")).distinct()
    dangling = cited.join(refs.select("doc_id", "ref_no"), ["doc_id", "ref_no"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))
    parts = zones(p).groupBy("doc_id").agg(F.count(F.when(F.col("zone") == "body", 1)).alias("body"), F.count(F.when(F.col("zone") == "references", 1)).alias("refs"))
    issue = lambda df, name, n: df.select("doc_id", F.lit(name).alias("issue"), n.alias("n"))
    return issue(dangling, "xref.unresolved", F.col("n")).union(issue(parts.filter("body = 0"), "body.missing", F.lit(1).cast("bigint"))).union(issue(parts.filter("refs = 0"), "references.missing", F.lit(1).cast("bigint")))


def reference_trace(p: DataFrame) -> DataFrame:
    """AG-26: (doc_id, entries, readable, linked) of documents with a reference list."""
    refs = group_entries(reference_lines(p))
    return refs.groupBy("doc_id").agg(F.count("*").alias("entries"), F.count(identity(F.col("text"))).alias("readable"), F.count(F.when(F.col("text").rlike(r"(?i)https?://|www\."), 1)).alias("linked"))
