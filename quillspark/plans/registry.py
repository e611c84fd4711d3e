"""Registered queries over the reference's own operators, with DuckDB SQL.

Each entry is (query, SQL or None).  The SQL reads `p` (manuscripts) and `r`
(their revisions), which with_views() defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import rewrites as R
from ..functions import texts
from ..functions.wordlists import NEGATIONS
from ..operators import changes, consistency, findings, guards, layout, recommend, references, scans, usage
from ..sources import corpus, operations, sinks
from ..sources import packages as cells_of
from . import jobs, structure
from .planting import manuscripts, revisions, with_views

Query = tuple

# Java's \b sees accented letters as word characters; RE2's doesn't.
ASCII = "regexp_replace(text, '[À-ɏ]', 'x', 'g')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.spread(spark.read.parquet(f"{d}/documents.parquet"))


def over(operator):
    """A query of the operator over the manuscripts."""
    return lambda spark, d: operator(manuscripts(spark, d))


def over_r(operator):
    return lambda spark, d: operator(revisions(spark, d))


def rewrite(f):
    """A query of a rewrite: the paragraphs that it changes."""
    return lambda spark, d: manuscripts(spark, d).select("doc_id", "idx", "text", f(F.col("text")).alias("new_text")).filter("text <> new_text").select("doc_id", "idx", "new_text")


def rewritten(f, plain: str, odd: str):
    """A query of a rewrite over all paragraphs, in which `plain` reads `odd` first: those that it changes."""
    return lambda spark, d: manuscripts(spark, d).withColumn("text", F.replace("text", F.lit(plain), F.lit(odd))).select("doc_id", "idx", "text", f(F.col("text")).alias("new_text")).filter("text <> new_text").select("doc_id", "idx", "new_text")


def counted(scan, *keys):
    """Findings of a scan, counted by paragraph."""
    return lambda spark, d: scan(manuscripts(spark, d)).groupBy("doc_id", "idx", *keys).agg(F.count("*").alias("hits"))


def ops(spark, d, name):
    return operations.derived(spark, d, name)


def refs_of(spark, d) -> DataFrame:
    return references.group_entries(references.reference_lines(manuscripts(spark, d)))


def _moved(spark, d) -> DataFrame:
    """Revisions of lists of five entries: of every third document the third comes first, of every next one the second is gone."""
    p = manuscripts(spark, d)
    start = p.filter("text = 'References'").groupBy("doc_id").agg(F.min("idx").alias("at"))
    entry = p.join(start, "doc_id").withColumn("k", F.col("idx") - F.col("at"))
    place = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("k") == 3, 1).when(F.col("k").isin(1, 2), F.col("k") + 1).otherwise(F.col("k"))).otherwise(F.col("k"))
    now = entry.select("doc_id", (F.col("at") + place).alias("idx"), F.when((F.col("doc_id") % 3 == 1) & (F.col("k") == 2), "").otherwise(F.col("text")).alias("edited"))
    return p.select("doc_id", "idx", F.col("text").alias("original")).join(now, ["doc_id", "idx"])


#: Citations of Quill, unless a name within 60 characters before is a word of the list or begins one.
NEAR_NAMES = """WITH h AS (SELECT doc_id, min(idx) AS at FROM p WHERE text = 'References' GROUP BY doc_id), l AS (
    SELECT DISTINCT p.doc_id, replace(lower(unnest(regexp_extract_all(p.text, '[A-Za-zÀ-ÿ''’-]{3,}'))), '’', '''') AS w FROM p JOIN h ON h.doc_id = p.doc_id AND p.idx > h.at
  ), c AS (SELECT p.doc_id, p.idx, p.text, strpos(p.text, '(Quill et al., 2019)') - 1 AS s FROM p JOIN h ON h.doc_id = p.doc_id AND p.idx < h.at WHERE contains(p.text, '(Quill et al., 2019)')
  ), n AS (SELECT doc_id, idx, replace(lower(unnest(list_append(regexp_extract_all(substr(text, greatest(s - 60, 0) + 1, least(s, 60) + 1), '[A-Z][A-Za-zÀ-ÿ''’-]{2,}'), 'quill'))), '’', '''') AS name FROM c
  ), k AS (SELECT DISTINCT n.doc_id, n.idx FROM n JOIN l ON l.doc_id = n.doc_id AND (n.name = l.w OR (length(n.name) >= 4 AND length(l.w) >= 4 AND (starts_with(n.name, l.w) OR starts_with(l.w, n.name)))))
  SELECT c.doc_id, c.idx, CAST(0 AS INTEGER) AS slot_no, 'Quill' AS surname, '2019' AS year, replace(c.text, 'Jones (2020)', '[8]') AS restored FROM c ANTI JOIN k ON k.doc_id = c.doc_id AND k.idx = c.idx"""


def hit_sql(pattern: str, where: str = "", text: str = ASCII) -> str:
    return f"SELECT doc_id, idx, CAST(len(regexp_extract_all({text}, '{pattern}')) AS BIGINT) AS hits FROM p WHERE len(regexp_extract_all({text}, '{pattern}')) > 0 {where}"


def rewrite_sql(expression: str, where: str = "") -> str:
    return f"SELECT doc_id, idx, new_text FROM (SELECT doc_id, idx, text, {expression} AS new_text FROM p) t WHERE text <> new_text {where}"


# A bibliography line of the manuscripts, on tidied text: numbered with a year, a named DOI, or a citation's volume and pages in a short line.
TIDIED = r"regexp_replace(translate(trim(text), '–—', '--'), '\s*([():;,-])\s*', '\1', 'g')"
NUMBERED_LINE = r"regexp_matches(text, '^\s*(\[\d{1,3}\]\.?|\[?\d{1,3}\.\]?)\s') AND len(list_filter(regexp_extract_all(text, '\d+'), lambda y: length(y) = 4 AND y BETWEEN '1900' AND '2099')) > 0"
NAMED_DOI = f"(contains(lower(text), 'doi') AND ({' OR '.join(f"regexp_matches(lower({TIDIED}), 'doi ?{form} ?10[.][0-9]{{4}}')" for form in P.DOI_FORMS)}))"
SHORT_LINE = f"(length(trim(text)) <= 400 AND ({' OR '.join(f"regexp_matches({TIDIED}, '{x}')" for x in P.NOTATIONS)}))"
IS_REF = f"(length(trim(text)) >= 25 AND (({NUMBERED_LINE}) OR {NAMED_DOI} OR {SHORT_LINE}))"
FOLDED = r"lower(regexp_replace(regexp_replace(trim(text), '^[\d.\s]+', ''), '[:.\-–—\s]+$', ''))"
ZONES = f"""z AS (SELECT p.doc_id, idx, text, CASE WHEN idx >= references_at THEN 'references' WHEN idx >= body_at THEN 'body' WHEN idx >= abstract_at AND body_at IS NOT NULL THEN 'abstract' WHEN body_at IS NULL THEN 'body' ELSE 'front' END AS zone
  FROM p JOIN (SELECT doc_id, min(idx) FILTER ({FOLDED} = 'abstract') AS abstract_at, min(idx) FILTER ({FOLDED} IN ('introduction', 'background')) AS body_at, min(idx) FILTER (regexp_matches({FOLDED}, '^(list of )?references?$|^bibliography$')) AS references_at FROM p GROUP BY doc_id) m ON p.doc_id = m.doc_id)"""
ENTRIES = f"""lines AS (SELECT doc_id, idx, trim(text) AS text FROM z WHERE zone = 'references' AND trim(text) <> '' AND NOT regexp_matches({FOLDED}, '^(list of )?references?$|^bibliography$')),
marked AS (SELECT *, regexp_matches(text, '^\\s*\\[?\\d{{1,3}}[\\].)]')::INT AS start FROM lines), counted AS (SELECT *, sum(start) OVER (PARTITION BY doc_id) >= 3 AS numbered FROM marked),
placed AS (SELECT *, CAST(CASE WHEN numbered THEN sum(start) OVER (PARTITION BY doc_id ORDER BY idx) ELSE row_number() OVER (PARTITION BY doc_id ORDER BY idx) END AS INT) AS ref_no FROM counted),
e AS (SELECT doc_id, ref_no, min(idx) AS idx, string_agg(text, ' ' ORDER BY idx) AS text FROM placed WHERE ref_no > 0 GROUP BY doc_id, ref_no)"""
SURNAME = r"lower(regexp_extract(text, '^\s*(?:\[?\d{1,3}[\].)]{0,2}\s*)?([A-Za-zÀ-ÿ''’-]{2,})', 1))"
YEAR = r"regexp_extract(text, '\b((?:19|20)\d{2})\b', 1)"
NUMBERED = f"""cites AS (SELECT DISTINCT doc_id, idx, grp, n FROM (SELECT doc_id, idx, grp, unnest(range(CAST(a AS BIGINT), CAST(b AS BIGINT) + 1)) AS n FROM (SELECT doc_id, idx, grp, regexp_extract(part, '^\\d+') AS a, regexp_extract(part, '\\d+$') AS b FROM (
  SELECT doc_id, idx, grp, unnest(regexp_extract_all(marker, '\\d+(?:\\s*[–-]\\s*\\d+)?')) AS part FROM (SELECT doc_id, idx, unnest(regexp_extract_all(text, '\\[\\d+(?:\\s*[,–-]\\s*\\d+)*\\]')) AS marker, unnest(range(len(regexp_extract_all(text, '\\[\\d+(?:\\s*[,–-]\\s*\\d+)*\\]')))) AS grp FROM p) x) y) w))"""
NEGATION = r"(?i)\b(?:" + "|".join(w.replace("'", "''") for w in sorted(NEGATIONS, key=len, reverse=True)) + r")\b"
NEG = lambda c: f"len(regexp_extract_all(regexp_replace({c}, '[À-ɏ]', 'x', 'g'), '{NEGATION}'))"
KIND = f"CASE WHEN trim(original) = '' THEN NULL WHEN trim(edited) = '' THEN 'emptied' WHEN {NEG('original')} > {NEG('edited')} THEN 'negation-lost' WHEN length(trim(original)) >= 120 AND length(edited) < length(original) * 0.7 THEN 'truncated' END"
NOW = "TIMESTAMP '2024-01-30 12:00:00'"


def now():
    return F.lit("2024-01-30 12:00:00").cast("timestamp")


def _mechanical_summary(spark, d):
    return findings.summarise(scans.mechanical(manuscripts(spark, d)))


# Chains of numbers and dashes; those that are one ascending range, by the lengths of their ends.
RANGES = f"""SELECT doc_id, idx, m FROM (SELECT doc_id, idx, unnest(regexp_extract_all(text, '[+\\w-]*\\d\\s*-\\s*\\d[\\w-]*')) AS m FROM p WHERE NOT {IS_REF}) x
  WHERE regexp_full_match(m, '\\d+\\s*-\\s*\\d+') AND CAST(regexp_extract(m, '^\\d+') AS HUGEINT) < CAST(regexp_extract(m, '\\d+$') AS HUGEINT)
  AND NOT (length(regexp_extract(m, '^\\d+')) >= 4 AND length(regexp_extract(m, '\\d+$')) >= 4) AND length(regexp_extract(m, '\\d+$')) - length(regexp_extract(m, '^\\d+')) < 3"""
_FOUND = f"""WITH f AS (
  SELECT doc_id, 'space.double' AS rule, 'warning' AS severity, len(regexp_extract_all(text, 'two  spaces stand')) AS n FROM p UNION ALL
  SELECT doc_id, 'punctuation.unbalanced-quotes', 'warning', (len(regexp_extract_all(text, '“')) <> len(regexp_extract_all(text, '”')))::INT FROM p UNION ALL
  SELECT doc_id, 'word.doubled', 'error', len(regexp_extract_all({ASCII}, '(?i)\\b(?:the\\s+the|of\\s+of|and\\s+and|is\\s+is|in\\s+in)\\b')) FROM p UNION ALL
  SELECT doc_id, 'space.before-punctuation', 'error', len(regexp_extract_all(text, '\\s+[,.;:!?]')) FROM p WHERE NOT {IS_REF} UNION ALL
  SELECT doc_id, 'space.after-punctuation', 'error', len(regexp_extract_all(text, 'ended\\.next')) FROM p UNION ALL
  SELECT doc_id, 'punctuation.unbalanced', 'error', contains(text, 'an open (bracket here')::INT FROM p UNION ALL
  SELECT doc_id, 'unit.spacing', 'info', contains(text, '12kg')::INT FROM p WHERE NOT {IS_REF} UNION ALL
  SELECT doc_id, 'dash.range', 'info', 1 FROM ({RANGES}) g)"""
_SUMMARY = _FOUND + """ SELECT doc_id, rule, severity, CAST(sum(n) AS BIGINT) AS n FROM f WHERE n > 0 GROUP BY GROUPING SETS ((doc_id, rule), (doc_id, severity), (doc_id))"""


def _journals(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    centre = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("embedding"))
    topics = F.array(*[F.lit(t) for t in ("Chemical Engineering", "Analytical Chemistry", "Law", "Computer Science", "Microbiology")])
    return centre.select(F.col("label").alias("cid"), F.concat(F.lit("Journal of Label "), F.col("label").cast("string")).alias("name"), F.array(F.element_at(topics, (F.col("label") % 5 + 1).cast("int"))).alias("topics"), F.array(F.lit("the"), F.lit("ununun")).alias("subject_areas"), "embedding", (F.col("label") % 5).cast("double").alias("impact_factor"))


def _vectors(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return docs(spark, d).select("doc_id", "text").join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left")


def _top(spark, d):
    return recommend.top_journals(recommend.scored_pairs(_vectors(spark, d).select("doc_id", "vector"), _journals(spark, d)))


TOP_SQL = """WITH c AS (SELECT label AS cid, list(v ORDER BY i) AS e FROM (SELECT label, i, avg(CAST(v AS DOUBLE)) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
s AS (SELECT d.doc_id, d.text, cid, coalesce(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 0.0) AS score FROM documents d LEFT JOIN embeddings m ON m.vec_id = d.doc_id CROSS JOIN c), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cid) AS rank FROM s)"""


# The pool by the same arithmetic: 80 points of the cosine, 20 of the topic words that a text contains.
POOL_SQL = TOP_SQL + """, w AS (SELECT *, ['chemical engineering', 'analytical chemistry', 'law', 'computer science', 'microbiology'][cid % 5 + 1] AS topic, lower(text) AS low FROM s),
h AS (SELECT doc_id, cid, score, coalesce(contains(low, 'the')::INT + contains(low, 'ununun')::INT + (contains(low, topic) OR len(list_filter(string_split(topic, ' '), lambda x: length(x) >= 4 AND contains(low, x))) > 0)::INT, 0) AS hits FROM w),
q AS (SELECT doc_id, cid, score, round_even(least(100.0, greatest(score, 0.0) * 80 + least(1.0, hits / 8.0) * 20), 1) AS prescreen FROM h),
pool AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY prescreen DESC, score DESC, cid) AS INTEGER) AS place FROM q),
gated AS (SELECT doc_id, cid, concat('Journal of Label ', CAST(cid AS STRING)) AS name, round_even(CASE WHEN score < 0.2 AND prescreen < 40 THEN (90.0 - place * 10) * 0.8 ELSE (90.0 - place * 10) * 0.45 + prescreen * 0.55 END, 1) AS fit FROM pool WHERE place IN (1, 2, 4))"""


def _pool(spark, d):
    """The candidates, written once: picks, matches and the rest all read them."""
    return sinks.written(recommend.candidate_pool(_vectors(spark, d), _journals(spark, d)), "candidates")


def _gated(pool):
    picks = pool.filter("place <= 4").select("doc_id", F.col("place").alias("pick_no"), F.when(F.col("place") == 2, F.col("cid") + 100).otherwise(F.col("cid")).alias("journal_id"), F.when(F.col("place") == 3, F.lit("Annals of Nothing")).otherwise(F.upper("name")).alias("journal_name"), (F.lit(90.0) - F.col("place") * 10).alias("fit"))
    return recommend.gate_picks(picks, pool)


def _fixed(pool):
    return recommend.recommend(_gated(pool), pool)


def _flags(spark, d):
    bench = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("source_id"), "text")
    return recommend.originality(corpus.paragraphs(docs(spark, d)), bench)


def _works(spark, d):
    """A catalogue with a work for each kind of short entry, derived from the documents."""
    return docs(spark, d).select((F.col("doc_id") % 9).alias("k")).distinct().select(F.concat(F.lit("10.5555/w"), F.col("k").cast("string")).alias("doi"), F.concat(F.lit("Short of pages number "), F.col("k").cast("string"), F.lit(" and more words here")).alias("title"), F.lit("Brown QX").alias("authors"), F.lit("J Gaps").alias("journal"), F.lit("2018").alias("year"), F.lit("7").alias("volume"), F.lit("1").alias("issue"), F.lit("1-9").alias("pages"))


#: Catalogues over k, the documents' ids modulo 9: titles as entries have them, with words more or fewer or in another order, and a review.
CATALOGUE = """SELECT concat('10.5555/w', CAST(k AS STRING)) AS doi, concat('Short of pages number ', CAST(k AS STRING), ' and more words here') AS title, 'journal-article' AS type FROM {k} UNION ALL
  SELECT concat('10.5555/g', CAST(k AS STRING)), concat('Growth of things in water number ', CAST(k AS STRING)), CASE WHEN k % 2 = 0 THEN 'review-article' ELSE '' END FROM {k} UNION ALL
  SELECT concat('10.5555/m', CAST(k AS STRING)), 'Hands that work: many', '' FROM {k} UNION ALL SELECT concat('10.5555/n', CAST(k AS STRING)), 'Many other hands at work', '' FROM {k}"""
SECOND = "SELECT concat('10.7777/h', CAST(k AS STRING)) AS doi, concat('Jones CD. Measures of heat. International Journal of the Heat', CAST(k AS STRING)) AS title FROM {k} UNION ALL SELECT concat('10.7777/s', CAST(k AS STRING)), 'Growth of things in water number one and two' FROM {k}"
WORKS_SQL = f"works AS ({CATALOGUE.format(k='k')}), second AS ({SECOND.format(k='k')})"


def _dois(spark, d):
    k = docs(spark, d).filter("text IS NOT NULL").select((F.col("doc_id") % 9).alias("k")).distinct()
    works, second = (spark.sql(sql, k=k) for sql in (CATALOGUE, SECOND))
    return references.fill_dois(refs_of(spark, d), works, second)


#: Some entries as works without a title, and as a chapter without pages.
ODD_ENTRY = "CASE WHEN ref_no = 2 AND doc_id % 3 = 0 THEN '[2]. Jones CD, editor. In: Handbook of heat and cold. Leiden: Gray Press; 2020.' WHEN ref_no = 3 AND doc_id % 3 = 1 THEN '[3]. Unesco.org. 2026. Available from: https://example.org/page/of/things' ELSE text END"


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    add = q.__setitem__
    # base tables
    add("paragraph_scan", (lambda s, d: corpus.paragraphs(docs(s, d)), "SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"))
    add("manuscripts", (over(lambda p: p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))), "SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM p GROUP BY doc_id"))
    add("zones", (over(lambda p: corpus.zones(p).select("doc_id", "idx", "zone")), f"WITH {ZONES} SELECT doc_id, idx, zone FROM z"))
    add("chunks", (over(lambda p: corpus.chunks(p).select("doc_id", "idx", "chunk")), "SELECT doc_id, idx, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1) // 5 AS INTEGER) AS chunk FROM p WHERE trim(text) <> ''"))
    add("unpaired", (lambda s, d: corpus.unpaired(manuscripts(s, d), manuscripts(s, d).filter("(doc_id + idx) % 9 <> 0")), "SELECT doc_id, count(*) AS only_original, CAST(0 AS BIGINT) AS only_edited FROM p WHERE (doc_id + idx) % 9 = 0 GROUP BY doc_id"))
    add("revision_pairs", (lambda s, d: corpus.pair(manuscripts(s, d), manuscripts(s, d).filter("idx % 2 = 0")).groupBy("doc_id").agg(F.count("*").alias("n")), "SELECT doc_id, count(*) AS n FROM p WHERE idx % 2 = 0 GROUP BY doc_id"))
    # revisions: losses and guards
    add("loss_by_kind", (over_r(guards.loss_by_kind), f"WITH k AS (SELECT doc_id, {KIND} AS kind FROM r WHERE original <> edited) SELECT doc_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY doc_id, kind"))
    link = r"(?i)https?://\S+|\bwww\.\S+"
    add("links_lost", (over_r(guards.links_lost), f"SELECT doc_id, idx, 'restore_reference_urls' AS guard, substr(original, 1, 80) AS snippet, concat(rtrim(edited), ' ', regexp_extract(original, '{link}')) AS restored FROM r WHERE regexp_matches(original, '{link}') AND NOT regexp_matches(edited, '{link}') AND trim(edited) <> ''"))
    add("guard_subscripts", (over_r(guards.subscript_markers), "SELECT doc_id, idx, 'keep_subscript_markers' AS guard, substr(original, 1, 80) AS snippet, replace(edited, 'R2', 'R^2') AS restored FROM r WHERE original <> edited AND original <> '' AND edited <> '' AND contains(original, 'R^2') AND NOT contains(edited, 'R^2') AND contains(edited, 'R2')"))
    add("guard_hyphens", (over_r(guards.hyphenation), "SELECT doc_id, idx, 'preserve_author_hyphenation' AS guard, substr(original, 1, 80) AS snippet, original AS restored FROM r WHERE contains(original, 'co-author') AND contains(edited, 'coauthor')"))
    add("guard_protected", (over_r(guards.protected_text), None))
    add("guard_equations", (lambda s, d: guards.equations(revisions(s, d).selectExpr("doc_id", "idx", "replace(original, 'Eq. (4)', '￼') AS original", "CASE WHEN doc_id % 2 = 0 THEN original ELSE replace(edited, 'Eq. (4)', '￼') END AS edited")), "SELECT doc_id, idx, 'keep_every_equation' AS guard, substr(o, 1, 80) AS snippet, o AS restored FROM (SELECT doc_id, idx, replace(original, 'Eq. (4)', '￼') AS o, CASE WHEN doc_id % 2 = 0 THEN original ELSE replace(edited, 'Eq. (4)', '￼') END AS e FROM r) t WHERE length(o) - length(replace(o, '￼', '')) <> length(e) - length(replace(e, '￼', ''))"))
    add("guard_bylines", (over_r(guards.byline_names), "SELECT doc_id, idx, 'restore_front_matter_names' AS guard, original AS snippet, original AS restored FROM r WHERE idx = 1 AND original <> edited"))
    add("guard_stars", (lambda s, d: guards.byline_names(manuscripts(s, d).selectExpr("doc_id", "idx", "CASE WHEN idx IN (0, 5) THEN concat('*1 Institute number ', doc_id) ELSE text END AS original", "CASE WHEN idx IN (0, 5) THEN concat(CASE WHEN doc_id % 2 = 0 THEN ' 1' ELSE '* 1' END, ' Institute number ', doc_id) ELSE text END AS edited")), "SELECT doc_id, idx, 'restore_front_matter_names' AS guard, concat('*1 Institute number ', doc_id) AS snippet, concat('*1 Institute number ', doc_id) AS restored FROM p WHERE idx = 0 AND doc_id % 2 = 0"))
    signs = "CASE doc_id % 3 WHEN 0 THEN ' 5 μm or 6 μm' WHEN 1 THEN ' 5 µm or 6 µm' ELSE ' 5 µm or 6 μm, 7 µm' END"
    add("guard_twins_mixed", (lambda s, d: guards.invisible_twins(manuscripts(s, d).selectExpr("doc_id", "idx", "concat(text, ' 5 µm or 6 μm') AS original", f"concat('So ', text, {signs}) AS edited")), "SELECT doc_id, idx, 'follow_the_author_on_invisible_twins' AS guard, substr(concat(text, ' 5 µm or 6 μm'), 1, 80) AS snippet, concat('So ', text, ' 5 µm or 6 μm') AS restored FROM p WHERE doc_id % 3 < 2"))
    add("guard_locants", (lambda s, d: guards.invented_locants(manuscripts(s, d).selectExpr("doc_id", "idx", "concat(text, ' of DTDA and 1,3-BPDA') AS original", "concat(text, CASE doc_id % 3 WHEN 0 THEN ' of 4,4′-DTDA and 1,3-BPDA' WHEN 1 THEN ' of DTDA and the 1,3-BPDA' ELSE ' of 2-DTDA, 3-DTDA and 1,3-BPDA' END) AS edited")), "SELECT doc_id, idx, 'refuse_invented_expansions' AS guard, substr(concat(text, ' of DTDA and 1,3-BPDA'), 1, 80) AS snippet, concat(text, CASE doc_id % 3 WHEN 0 THEN ' of DTDA and 1,3-BPDA' ELSE ' of DTDA, DTDA and 1,3-BPDA' END) AS restored FROM p WHERE doc_id % 3 <> 1"))
    add("entry_moves", (lambda s, d: guards.entry_moves(_moved(s, d)), "SELECT DISTINCT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 3 ELSE 2 END AS INTEGER) AS ref_no, CAST(CASE doc_id % 3 WHEN 0 THEN 1 END AS INTEGER) AS now_no, CASE doc_id % 3 WHEN 0 THEN 'moved' ELSE 'lost' END AS change FROM p WHERE doc_id % 3 < 2"))
    add("guard_entry_numbers", (lambda s, d: guards.entry_numbers(revisions(s, d).withColumn("edited", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("edited", r"^\[\d\]\. ", "")).otherwise(F.col("edited")))), None))
    add("guard_compounds", (lambda s, d: guards.closed_compounds(revisions(s, d).withColumn("edited", F.replace("original", F.lit("Introduction"), F.lit("Intro duction")))), None))
    add("guard_captions", (lambda s, d: guards.caption_values(revisions(s, d).selectExpr("doc_id", "idx", "CASE WHEN original LIKE 'Figure 3. What%' THEN 'Figure 3. Plot for T4 at 80 g' ELSE original END AS original", "CASE WHEN original LIKE 'Figure 3. What%' THEN 'Figure 3. Plot for T5 at 80 g' ELSE original END AS edited")), "SELECT doc_id, idx, 'keep_caption_values' AS guard, 'Figure 3. Plot for T4 at 80 g' AS snippet, 'Figure 3. Plot for T4 at 80 g' AS restored FROM p WHERE text LIKE 'Figure 3. What%'"))
    add("guard_expansions", (over_r(lambda r: guards.invented_expansions(r.withColumn("edited", F.replace("edited", F.lit("the AGC held"), F.lit("the Added Gain Control (AGC) held"))))), None))
    add("guard_twins", (lambda s, d: guards.invisible_twins(revisions(s, d).selectExpr("doc_id", "idx", "concat(original, ' 5 µm') AS original", "concat(edited, CASE WHEN doc_id % 3 = 0 THEN ' 5 μm' ELSE ' 5 µm' END) AS edited")), "SELECT doc_id, idx, 'follow_the_author_on_invisible_twins' AS guard, substr(concat(original, ' 5 µm'), 1, 80) AS snippet, concat(edited, ' 5 µm') AS restored FROM r WHERE doc_id % 3 = 0"))
    add("guard_broken_subscripts", (lambda s, d: guards.broken_subscripts(revisions(s, d).withColumn("edited", F.replace("edited", F.lit("5 mm"), F.lit("₀.₀₁ mm")))), "SELECT doc_id, idx, 'undo_broken_subscripts' AS guard, substr(original, 1, 80) AS snippet, replace(edited, '5 mm', '0.01 mm') AS restored FROM r WHERE contains(edited, '5 mm')"))
    add("guard_orphan_formulas", (lambda s, d: guards.orphan_formulas(revisions(s, d).selectExpr("doc_id", "idx", "CASE WHEN idx % 7 = 6 THEN 'TP+ FN (3)' ELSE original END AS original", "CASE WHEN idx % 7 = 5 THEN 'Recall = TP / (TP + FN)' WHEN idx % 7 = 6 THEN 'TP+ FN (3)' ELSE edited END AS edited")), "SELECT doc_id, idx, 'orphaned_formula_queries' AS guard, 'TP+ FN (3)' AS snippet, '' AS restored FROM r WHERE idx % 7 = 6"))
    add("guard_all", (over_r(guards.run_guards), None))
    add("guard_restored", (over_r(lambda r: guards.restored(r).groupBy("doc_id").agg(F.count("*").alias("n"))), "SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id"))
    add("missing_tokens", (over_r(guards.missing_tokens), None))
    add("dangling_citations", (over_r(lambda r: guards.dangling_citations(r.withColumn("edited", F.replace(F.replace("original", F.lit("(Quill et al., 2019)"), F.lit("[9]")), F.lit("Jones (2020)"), F.lit("[8]"))))), NEAR_NAMES))
    add("references_lost", (over_r(guards.references_lost), None))
    add("propagate_changes", (over_r(guards.propagate_changes), None))
    add("propagate_cells", (lambda s, d: guards.propagate_to_cells(revisions(s, d), structure.table(s, d, structure.EDITED_CELLS)), None))
    add("first_use", (over_r(guards.first_use), None))
    add("moved_numbers", (over_r(guards.moved_numbers), None))
    add("loss_report", (over_r(guards.loss_report), None))
    add("cell_edits", (lambda s, d: guards.cell_edits(structure.table(s, d, structure.EDITED_CELLS)), None))
    # word-level changes
    add("recurring_changes", (over_r(lambda r: changes.recurring_changes(r.withColumn("edited", F.regexp_replace("original", r"\bthe\b", "that")))), None))
    add("chunk_edits", (over_r(lambda r: changes.chunk_edits(r).drop("spans")), None))
    add("salvage", (over_r(changes.salvage), None))
    add("change_counts", (over_r(changes.change_counts), None))
    add("realign_chunks", (lambda s, d: changes.realign_chunks(manuscripts(s, d), corpus.chunks(manuscripts(s, d)).filter("NOT (chunk = 1 AND pos = 0 AND doc_id % 2 = 0)").selectExpr("doc_id", "chunk", "pos", "upper(text) AS edited"))[1], "WITH c AS (SELECT doc_id, idx, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1) // 5 AS INTEGER) AS chunk FROM p WHERE trim(text) <> '') SELECT doc_id, idx, chunk FROM c WHERE chunk = 1 AND doc_id % 2 = 0"))
    add("verify_model_findings", (lambda s, d: changes.verify_model_findings(manuscripts(s, d).filter("idx % 2 = 0").selectExpr("doc_id", "idx", "CASE WHEN idx % 4 = 0 THEN 'AGC is never defined' ELSE 'unclear' END AS problem", "CASE WHEN doc_id % 3 = 0 THEN 'AGC held' ELSE 'zzz' END AS fragment"), manuscripts(s, d)), "SELECT q.doc_id, q.idx, CASE WHEN q.idx % 4 = 0 THEN 'AGC is never defined' ELSE 'unclear' END AS problem, 'AGC held' AS fragment FROM p q WHERE q.idx % 2 = 0 AND q.doc_id % 3 = 0 AND contains(q.text, 'AGC held') AND NOT (q.idx % 4 = 0 AND EXISTS (SELECT 1 FROM p x WHERE x.doc_id = q.doc_id AND x.idx < q.idx AND contains(x.text, '(AGC)')))"))
    add("review_summary", (over_r(lambda r: changes.review_summary(r, r.filter("idx % 3 = 0").selectExpr("doc_id", "idx", "CASE WHEN doc_id % 2 = 0 THEN 'reject' ELSE 'accept' END AS decision", "1 AS ts"))), "SELECT doc_id, count(*) AS asked, count(*) - count(*) FILTER (idx % 3 = 0 AND doc_id % 2 = 0) AS accepted, count(*) FILTER (idx % 3 = 0 AND doc_id % 2 = 0) AS rejected FROM r WHERE original <> edited GROUP BY doc_id"))
    # scans
    add("ms1_double_spaces", (counted(scans.double_spaces), hit_sql(r"\S {2,}", "AND regexp_matches(text, ''\\S {2,}\\S'')".replace("''", "'"), "text")))
    add("ms2_space_before_punctuation", (counted(scans.space_before_punctuation), f"SELECT doc_id, idx, CAST(len(regexp_extract_all(text, '\\s+[,.;:!?]')) AS BIGINT) AS hits FROM p WHERE regexp_matches(text, '\\s+[,.;:!?]') AND NOT {IS_REF}"))
    add("ms3_space_after_punctuation", (counted(scans.space_after_punctuation), "SELECT doc_id, idx, CAST(len(regexp_extract_all(text, 'ended\\.next')) AS BIGINT) AS hits FROM p WHERE contains(text, 'ended.next')"))
    add("ms4_unbalanced", (lambda s, d: scans.unbalanced_brackets(manuscripts(s, d)).select("doc_id", "idx", "rule"), "SELECT doc_id, idx, 'punctuation.unbalanced' AS rule FROM p WHERE contains(text, 'an open (bracket here')"))
    add("ms5_quotes", (counted(scans.unbalanced_quotes), "SELECT doc_id, idx, CAST(1 AS BIGINT) AS hits FROM p WHERE len(regexp_extract_all(text, '“')) <> len(regexp_extract_all(text, '”'))"))
    add("ms6_ranges", (counted(scans.hyphen_ranges, "suggestion"), f"SELECT doc_id, idx, regexp_replace(m, '\\s*-\\s*', '–') AS suggestion, count(*) AS hits FROM ({RANGES}) g GROUP BY ALL"))
    add("ms7_units", (counted(scans.unit_spacing), f"SELECT doc_id, idx, CAST(1 AS BIGINT) AS hits FROM p WHERE contains(text, '12kg') AND NOT {IS_REF}"))
    add("ms8_doubled", (counted(scans.doubled_words), hit_sql(r"(?i)\b(?:the\s+the|of\s+of|and\s+and|is\s+is|in\s+in)\b")))
    add("ms10_formulas", (over(lambda p: scans.formula_digits(p).select("doc_id", "idx", "fragment")), "SELECT doc_id, min(idx) AS idx, f AS fragment FROM p, (SELECT unnest(['FeCl3', 'H2O']) AS f) x WHERE contains(text, concat(' ', f, ' ')) GROUP BY doc_id, f"))
    add("ms11_script_markers", (lambda s, d: scans.script_markers(manuscripts(s, d).withColumn("text", F.replace("text", F.lit("5 mm"), F.lit("5 cm-1 at λmax")))).select("doc_id", "idx", "rule", "fragment"), "SELECT doc_id, min(idx) AS idx, CASE f WHEN 'cm-1' THEN 'format.superscript' ELSE 'format.subscript' END AS rule, f AS fragment FROM p, (SELECT unnest(['cm-1', 'λmax']) AS f) x WHERE contains(text, '5 mm') GROUP BY doc_id, f"))
    add("ms12_links", (over(scans.links), None))
    add("ms13_orcids", (over(lambda p: scans.orcids(p).drop("name")), "SELECT doc_id, min(idx) AS idx, o AS orcid, o = '0000-0002-1825-0097' AS ok FROM p, (SELECT unnest(['0000-0002-1825-0097', '0000-0002-1825-0098']) AS o) x WHERE contains(text, o) GROUP BY doc_id, o"))
    add("ms14_greek", (lambda s, d: scans.greek_letters(manuscripts(s, d).withColumn("text", F.replace("text", F.lit("5 mm"), F.lit("an α phase")))), "SELECT doc_id, 'α' AS letter, 'italic' AS style, CAST(count(*) AS BIGINT) AS n FROM p WHERE contains(text, '5 mm') GROUP BY doc_id"))
    add("ms15_tokens", (over(lambda p: scans.technical_tokens(p).groupBy("doc_id", "key").agg(F.count("*").alias("n"))), None))
    add("ms16_resolution", (lambda s, d: scans.image_resolution(structure.table(s, d, structure.IMAGES)), f"WITH i AS ({structure.duck(structure.IMAGES)}), x AS (SELECT doc_id, image_no, CAST(round_even(least(px_w / in_w, px_h / in_h), 0) AS INTEGER) AS dpi FROM i WHERE in_w > 0.5 AND in_h > 0.5) SELECT doc_id, image_no, 'image.resolution' AS rule, CASE WHEN dpi < 150 THEN 'error' ELSE 'warning' END AS severity, dpi FROM x WHERE dpi < 300"))
    add("ms17_sentences", (over(lambda p: scans.sentences(p).groupBy("doc_id").agg(F.count("*").alias("n"))), None))
    add("ms18_citation_numbers", (over(lambda p: scans.citation_numbers(p)), f"WITH {NUMBERED} SELECT doc_id, idx, CAST(grp AS INTEGER) AS \"group\", n FROM cites"))
    add("ms19_citation_slots", (over(lambda p: scans.citation_slots(p).drop("slot_no", "start")), f"SELECT doc_id, idx, 'author-date' AS kind, s AS surname, y AS year, w AS written FROM p, (SELECT unnest(['Quill', 'Jones', 'Brown']) AS s, unnest(['2019', '2020', '2018']) AS y, unnest(['(Quill et al., 2019)', 'Jones (2020)', '(Brown, 2018)']) AS w) x WHERE contains(text, w) UNION ALL SELECT doc_id, idx, 'number', NULL, NULL, unnest(regexp_extract_all(text, '\\[\\d+(?:\\s*[,–-]\\s*\\d+)*\\]')) FROM p WHERE NOT {IS_REF}"))
    add("ms20_lengths", (over(lambda p: scans.length_checks(p).select("doc_id", "idx", "rule", "fragment")), "SELECT doc_id, idx, 'keywords.count' AS rule, CASE WHEN doc_id % 3 = 0 THEN '3' ELSE '2' END AS fragment FROM p WHERE starts_with(text, 'Keywords:') UNION ALL SELECT doc_id, idx, 'title.length', CAST(length(text) AS STRING) FROM p WHERE idx = 0 AND length(text) > 60"))
    add("ms9_species", (lambda s, d: scans.species_italic(manuscripts(s, d).withColumn("text", F.when(F.col("idx") % 4 == 0, F.concat(F.lit("Oryza sativa and "), "text")).otherwise(F.col("text"))), structure.table(s, d, structure.RUNS).selectExpr("doc_id", "idx", "run_no * 40 AS start", "run_no * 40 + length(text) AS end", "italic")).select("doc_id", "idx", "fragment"), f"WITH f AS (SELECT doc_id, min(idx) AS idx FROM p WHERE idx % 4 = 0 GROUP BY doc_id), x AS ({structure.duck(structure.RUNS)}) SELECT f.doc_id, f.idx, 'Oryza sativa' AS fragment FROM f JOIN x ON f.doc_id = x.doc_id AND f.idx = x.idx AND x.run_no = 0 WHERE NOT coalesce(italic, false)"))
    add("mechanical_summary", (_mechanical_summary, _SUMMARY))
    # consistency
    add("acronyms", (over(consistency.acronyms), None))
    add("abstract_abbreviations", (over(lambda p: consistency.abstract_abbreviations(corpus.zones(p))), "SELECT doc_id, 'WHO' AS acronym, CAST(3 AS INTEGER) AS idx FROM p WHERE idx = 3"))
    add("cross_references", (over(consistency.cross_references), None))
    add("equations", (over(lambda p: consistency.equation_numbers(p)), "SELECT doc_id, CAST(4 AS INTEGER) AS n, min(idx) AS idx FROM p WHERE contains(text, 'Eq. (4)') GROUP BY doc_id"))
    add("variant_vote", (over(lambda p: consistency.variant_vote(p)), "WITH n AS (SELECT doc_id, count(*) FILTER (contains(text, 'the colour and behavior of a fibre')) AS k FROM p GROUP BY doc_id) SELECT doc_id, CAST(2 * k AS BIGINT) AS uk, k + 2 AS us, CASE WHEN 3 * k + 2 >= 5 AND greatest(2 * k, k + 2) >= 0.6 * (3 * k + 2) THEN CASE WHEN 2 * k >= k + 2 THEN 'UK' ELSE 'US' END END AS variant FROM n"))
    add("spelling_clash", (lambda s, d: consistency.spelling_clash(manuscripts(s, d).withColumn("text", F.when(F.floor(F.col("idx") / 28) % 2 == 0, F.replace("text", F.lit("colour"), F.lit("color"))).otherwise(F.col("text")))), "WITH n AS (SELECT doc_id, count(*) FILTER (idx // 28 % 2 = 1) AS n_uk, count(*) FILTER (idx // 28 % 2 = 0) AS n_us FROM p WHERE contains(text, 'the colour and') GROUP BY doc_id) SELECT doc_id, 'colour' AS uk, 'color' AS us, CAST(n_uk AS BIGINT) AS n_uk, CAST(n_us AS BIGINT) AS n_us, CASE WHEN n_uk >= n_us THEN 'UK' ELSE 'US' END AS keep FROM n WHERE n_uk > 0 AND n_us > 0"))
    add("label_clash", (over(consistency.label_clash), f"SELECT * FROM (SELECT doc_id, CAST(sum(len(regexp_extract_all({ASCII}, '\\bFig\\.\\s*\\d'))) AS BIGINT) AS fig, CAST(sum(len(regexp_extract_all({ASCII}, '\\bFigure\\s*\\d'))) AS BIGINT) AS figure FROM p GROUP BY doc_id) t WHERE fig > 0 AND figure > 0"))
    add("abbreviations", (over(consistency.learn_abbreviations), None))
    # findings
    add("collapse_repeats", (over(lambda p: findings.collapse_repeats(scans.unit_spacing(p))), None))
    add("prevalence", (lambda s, d: findings.prevalence(scans.unbalanced_quotes(manuscripts(s, d)).unionByName(scans.doubled_words(manuscripts(s, d))), docs(s, d)), f"WITH f AS (SELECT DISTINCT doc_id, 'punctuation.unbalanced-quotes' AS rule FROM p WHERE len(regexp_extract_all(text, '“')) <> len(regexp_extract_all(text, '”')) UNION SELECT DISTINCT doc_id, 'word.doubled' FROM p WHERE regexp_matches({ASCII}, '(?i)\\b(?:the\\s+the|of\\s+of|and\\s+and|is\\s+is|in\\s+in)\\b')) SELECT rule, count(*) AS docs, round(count(*) / (SELECT count(*) FROM documents), 6) AS share, count(*) / (SELECT count(*) FROM documents) > 0.55 AS routine FROM f GROUP BY rule"))
    add("report_rows", (over(lambda p: findings.report_rows(scans.unit_spacing(p)).select("doc_id", "rule", "n", "first_idx")), f"SELECT doc_id, 'unit.spacing' AS rule, count(*) AS n, min(idx) AS first_idx FROM p WHERE contains(text, '12kg') AND NOT {IS_REF} GROUP BY doc_id"))
    add("author_gaps", (over(lambda p: findings.author_gaps(consistency.acronyms(p).select("doc_id", "idx", "rule", F.col("acronym").alias("fragment")))), None))
    add("audience", (over(lambda p: findings.for_audience(scans.mechanical(p), "internal").groupBy("doc_id").agg(F.count("*").alias("n"))), _FOUND + " SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM f WHERE n > 0 GROUP BY doc_id"))
    # bibliography
    add("ref_entries", (lambda s, d: refs_of(s, d), f"WITH {ZONES}, {ENTRIES} SELECT doc_id, ref_no, idx, text FROM e"))
    add("bibliography_census", (lambda s, d: references.bibliography_census(refs_of(s, d)), f"WITH {ZONES}, {ENTRIES} SELECT doc_id, {SURNAME} AS surname, {YEAR} AS year, count(*) AS n FROM e WHERE {SURNAME} <> '' AND {YEAR} <> '' GROUP BY ALL"))
    add("caption_census", (over(references.caption_census), r"SELECT doc_id, CASE lower(regexp_extract(text, '(?i)^\s*(fig|figure|table|scheme|eq|equation)\.?\s*[:\-–]?\s*(\d+)', 1)) WHEN 'fig' THEN 'figure' WHEN 'figure' THEN 'figure' WHEN 'eq' THEN 'equation' ELSE lower(regexp_extract(text, '(?i)^\s*(fig|figure|table|scheme|eq|equation)\.?\s*[:\-–]?\s*(\d+)', 1)) END AS kind, regexp_extract(text, '(?i)^\s*(fig|figure|table|scheme|eq|equation)\.?\s*[:\-–]?\s*(\d+)', 2) AS number, count(*) AS n FROM p WHERE regexp_matches(text, '(?i)^\s*(fig|figure|table|scheme|eq|equation)\.?\s*[:\-–]?\s*(\d+)') GROUP BY ALL"))
    add("census_diff", (over_r(lambda r: references.census_diff(references.caption_census(r.select("doc_id", "idx", F.col("original").alias("text"))), references.caption_census(r.select("doc_id", "idx", F.col("edited").alias("text"))), ["doc_id", "kind", "number"])), None))
    add("ref_gaps", (lambda s, d: references.incomplete_refs(refs_of(s, d).withColumn("text", F.expr(ODD_ENTRY))).select("doc_id", "ref_no", F.array_join("missing", ",").alias("missing")), f"WITH {ZONES}, {ENTRIES} SELECT doc_id, ref_no, CASE WHEN ref_no = 2 THEN 'chapter page range' WHEN ref_no = 3 THEN 'title,authors' ELSE 'volume/issue,pages' END AS missing FROM e WHERE contains(text, 'J Gaps. 2018.') OR (ref_no = 2 AND doc_id % 3 = 0) OR (ref_no = 3 AND doc_id % 3 = 1)"))
    add("mark_gaps", (lambda s, d: references.mark_gaps(refs_of(s, d)).select("doc_id", "ref_no", "text"), f"WITH {ZONES}, {ENTRIES} SELECT doc_id, ref_no, CASE WHEN ends_with(text, 'J Gaps. 2018.') THEN concat(substr(text, 1, length(text) - 1), ' [volume/issue, pages missing].') ELSE text END AS text FROM e"))
    add("ref_parse", (lambda s, d: references.parse_refs(refs_of(s, d)).select("doc_id", "ref_no", "kind", "authors", "year", "volume", "issue", "pages"), None))
    add("duplicate_refs", (lambda s, d: references.duplicate_refs(refs_of(s, d)), "SELECT doc_id, CAST(5 AS INTEGER) AS ref_no, CAST(4 AS INTEGER) AS first_ref FROM documents WHERE doc_id % 5 = 0 AND doc_id % 9 = 1"))
    add("journal_style", (lambda s, d: references.journal_style(refs_of(s, d)).select("doc_id", "ref_no", "journal"), None))
    add("complete_refs", (lambda s, d: references.complete_references(refs_of(s, d), _works(s, d)), None))
    add("fill_dois", (_dois, None))
    add("book_places", (lambda s, d: references.book_places(refs_of(s, d), docs(s, d).select((F.col("doc_id") % 50).alias("k")).distinct().select(F.concat(F.lit("Growth of things in water number "), F.col("k").cast("string")).alias("title"), F.array(F.lit("J Test Sci")).alias("publishers"), F.array(F.lit("Leiden")).alias("places"))), f"WITH {ZONES}, {ENTRIES} SELECT doc_id, ref_no, 'Leiden' AS place FROM e WHERE ref_no = 1"))
    add("renumber", (lambda s, d: references.renumber(manuscripts(s, d), refs_of(s, d)), f"WITH {ZONES}, {ENTRIES}, {NUMBERED}, f AS (SELECT c.doc_id, n AS ref_no, min(struct_pack(a := c.idx, b := grp, c := n)) AS place FROM cites c ANTI JOIN e ON c.doc_id = e.doc_id AND c.idx = e.idx GROUP BY ALL) SELECT e.doc_id, e.ref_no, CAST(row_number() OVER (PARTITION BY e.doc_id ORDER BY f.place IS NULL, f.place, e.ref_no) AS INTEGER) AS new_no FROM e LEFT JOIN f ON e.doc_id = f.doc_id AND e.ref_no = f.ref_no"))
    add("number_citations", (lambda s, d: references.number_citations(manuscripts(s, d), refs_of(s, d)).select("doc_id", "idx", "ref_no"), None))
    add("citation_counts", (lambda s, d: references.citation_counts(manuscripts(s, d), refs_of(s, d)), f"WITH {ZONES}, {ENTRIES}, {NUMBERED} SELECT e.doc_id, e.ref_no, count(x.n) AS cited FROM e LEFT JOIN (SELECT c.* FROM cites c ANTI JOIN e ON c.doc_id = e.doc_id AND c.idx = e.idx) x ON x.doc_id = e.doc_id AND x.n = e.ref_no GROUP BY ALL"))
    add("article_tables", (over(lambda p: references.article_tables(p).withColumns({"items": F.array_join("items", "|"), "xrefs": F.array_join("xrefs", ",")})), None))
    add("validate_article", (lambda s, d: references.validate_article(manuscripts(s, d), refs_of(s, d)), f"WITH {ZONES}, {ENTRIES}, {NUMBERED} SELECT doc_id, 'xref.unresolved' AS issue, count(*) AS n FROM (SELECT DISTINCT c.doc_id, c.n FROM cites c ANTI JOIN e ON c.doc_id = e.doc_id AND c.idx = e.idx) u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = u.doc_id AND e.ref_no = u.n) GROUP BY doc_id"))
    add("reference_trace", (over(references.reference_trace), f"WITH {ZONES}, {ENTRIES} SELECT doc_id, count(*) AS entries, count(*) FILTER ({SURNAME} <> '' AND {YEAR} <> '') AS readable, count(*) FILTER (regexp_matches(text, '(?i)https?://|www\\.')) AS linked FROM e GROUP BY doc_id"))
    # rewrites
    add("rw1_authors", (rewrite(R.cap_authors), rewrite_sql("replace(text, 'Ford FF, Gray GG. Many', 'Ford FF, et al. Many')")))
    add("rw2_year", (rewrite(R.year_only), rewrite_sql("CASE WHEN starts_with(text, '[2]. Jones CD.') THEN replace(text, 'July 2020;', '2020;') ELSE text END")))
    add("rw3_parens", (rewrite(R.drop_paren_cite), rewrite_sql("replace(text, ' (Brown, 2018) [7]', ' [7]')")))
    add("rw4_keywords", (rewrite(R.keywords_line), rewrite_sql("CASE text WHEN 'Keywords: zeta; alpha, Beta' THEN 'Keywords: Alpha, Beta, zeta' WHEN 'Keywords: gamma, delta' THEN 'Keywords: Delta, gamma' ELSE text END")))
    add("rw5_brackets", (rewrite(R.element_brackets), rewrite_sql("replace(text, '[Figure 2]', '(Figure 2)')")))
    add("rw6_temperature", (rewrite(R.temperature), rewrite_sql("replace(replace(text, '550 °C', '550°C'), '80 °C', '80°C')")))
    add("rw7_formulas", (rewrite(R.formula_subs), rewrite_sql("replace(replace(text, 'FeCl3', 'FeCl₃'), 'H2O', 'H₂O')")))
    add("rw8_all_formulas", (lambda s, d: R.formula_subs_all(manuscripts(s, d)).join(manuscripts(s, d).withColumnRenamed("text", "was"), ["doc_id", "idx"]).filter("text <> was").select("doc_id", "idx", F.col("text").alias("new_text")), None))
    add("rw9_symbols", (rewritten(R.symbols, "5 mm", "∆s° and ∆T"), "SELECT doc_id, idx, replace(text, '5 mm', 'ΔS° and ΔT') AS new_text FROM p WHERE contains(text, '5 mm')"))
    add("rw10_units", (rewrite(R.unit_case), rewrite_sql("replace(text, '5 KJ and 3 MHZ', '5 kJ and 3 MHz')")))
    add("rw11_variant", (rewrite(R.language_variant), rewrite_sql("replace(replace(replace(text, 'behavior', 'behaviour'), 'Organization', 'Organisation'), 'Gray GG', 'Grey GG')")))
    add("rw12_trailing", (rewrite(R.trailing_cite), rewrite_sql("CASE WHEN ends_with(text, ' it was reached. [17]') THEN replace(text, 'reached. [17]', 'reached [17].') ELSE text END")))
    add("rw13_collapse", (lambda s, d: R.collapse_symbols(manuscripts(s, d).withColumn("text", F.replace("text", F.lit("R^2 of"), F.lit("R2R^2 of"))).withColumn("was", F.col("text"))).filter("text <> was").drop("was"), "SELECT doc_id, idx, text FROM p WHERE contains(text, 'R^2 of')"))
    add("rw15_mask", (lambda s, d: manuscripts(s, d).select("doc_id", "idx", R.mask_opaque(F.col("text")).alias("masked")).groupBy("doc_id").agg(F.sum(F.length("masked")).alias("chars"), F.sum(F.regexp_count("masked", F.lit("https?://"))).alias("links")), "SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS links FROM p GROUP BY doc_id"))
    add("rw16_labels", (rewrite(R.element_labels), rewrite_sql("replace(replace(text, 'Fig. 4', 'Figure 4'), 'x', 'x')")))
    add("rw17_citation_punct", (rewritten(R.citation_punct, "[1, 3–5]", "[1,3-5]"), "SELECT doc_id, idx, text AS new_text FROM p WHERE contains(text, '[1, 3–5]')"))
    add("rw18_headings", (rewrite(R.heading_case), "SELECT doc_id, idx, upper(text) AS new_text FROM p WHERE text IN ('Abstract', 'Introduction', 'References')"))
    add("house_rewrite", (lambda s, d: R.house_rewrite(manuscripts(s, d)).groupBy("doc_id").agg(F.count("*").alias("n")), "SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id"))
    # predicates
    add("fil_references", (over(lambda p: p.filter(P.is_reference_block(F.col("text"))).select("doc_id", "idx")), f"SELECT doc_id, idx FROM p WHERE {IS_REF}"))
    add("fil_citations", (over(lambda p: p.filter(P.is_citation_sentence(F.col("text"))).select("doc_id", "idx")), f"SELECT doc_id, idx FROM p WHERE (regexp_matches({ASCII}, '\\b(19|20)\\d{{2}}\\b') AND (regexp_matches({ASCII}, '(?i)\\bet\\s+al\\b') OR length(text) - length(replace(text, ',', '')) >= 4)) OR regexp_matches(text, '(?i)doi\\.org|https://')"))
    add("fil_kinds", (over(lambda p: p.groupBy(P.query_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))), f"SELECT CASE WHEN {IS_REF} THEN 'Reference' WHEN regexp_matches(text, '(?i)^\\s{{0,2}}fig(ure)?\\s*\\.?\\s*\\d') OR regexp_matches(text, '(?i)^\\s{{0,2}}tab(le)?\\s*\\.?\\s*\\d') THEN 'Caption' ELSE 'prose' END AS kind, count(*) AS n FROM p GROUP BY 1"))
    add("fil_formulas", (over(lambda p: scans.hits(p, r"(?<![A-Za-z0-9])[A-Z][A-Za-z0-9]{1,14}(?![A-Za-z0-9])").filter(P.is_formula(F.col("match"))).groupBy("match").agg(F.count("*").alias("n"))), None))
    # operations
    add("daily_stats", (lambda s, d: usage.daily_stats(ops(s, d, "process_logs")).select("day", "jobs", "paragraphs", F.round("avg_duration", 4).alias("avg_duration"), "successes"), f"WITH l AS ({operations.LOGS}) SELECT CAST(timestamp AS DATE) AS day, count(*) AS jobs, CAST(sum(paragraphs_count) AS BIGINT) AS paragraphs, round(avg(duration_seconds), 4) AS avg_duration, CAST(count(*) FILTER (status = 'Success') AS BIGINT) AS successes FROM l GROUP BY 1 ORDER BY 1 DESC LIMIT 90"))
    add("role_counts", (lambda s, d: usage.role_counts(ops(s, d, "users")), f"WITH u AS ({operations.USERS}) SELECT role, count(*) AS n FROM u GROUP BY role"))
    add("queue_stats", (lambda s, d: usage.queue_stats(ops(s, d, "jobs")), f"WITH j AS ({operations.JOBS}) SELECT status, count(*) AS n FROM j GROUP BY status"))
    add("table_counts", (lambda s, d: usage.table_counts({n: ops(s, d, n) for n in ("users", "process_logs", "jobs")}), "SELECT 'users' AS name, count(*) AS n FROM customer UNION ALL SELECT 'process_logs', count(*) FROM orders UNION ALL SELECT 'jobs', count(*) FROM events"))
    month = "SELECT user_id, strftime(created_at, '%Y-%m') AS month, count(*) AS jobs, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, sum(cost_usd) AS cost_usd, CAST(sum(prompt_tokens) + sum(completion_tokens) AS BIGINT) AS total_tokens FROM j GROUP BY ALL"
    add("month_usage", (lambda s, d: usage.month_usage(ops(s, d, "jobs")), f"WITH j AS ({operations.JOBS}) {month}"))
    add("quota", (lambda s, d: usage.quota(ops(s, d, "users"), usage.month_usage(ops(s, d, "jobs")), "2024-01"), f"WITH j AS ({operations.JOBS}), m AS ({month}), u AS ({operations.USERS}), q AS (SELECT id AS user_id, coalesce(jobs, 0) AS jobs_used, CAST(CASE WHEN role IN ('admin', 'superadmin') THEN 0 ELSE coalesce(monthly_job_cap, 3) END AS BIGINT) AS jobs_cap, coalesce(total_tokens, 0) AS used, CAST(CASE WHEN role IN ('admin', 'superadmin') THEN 0 ELSE coalesce(monthly_token_cap, 0) END AS BIGINT) AS cap FROM u LEFT JOIN m ON u.id = m.user_id AND m.month = '2024-01') SELECT *, CASE WHEN jobs_cap > 0 AND jobs_used >= jobs_cap THEN 'jobs' WHEN cap > 0 AND used >= cap THEN 'tokens' END AS reason, CASE WHEN jobs_cap > 0 AND jobs_used >= jobs_cap THEN false WHEN cap > 0 AND used >= cap THEN false ELSE true END AS allowed FROM q"))
    add("locked_out", (lambda s, d: usage.locked_out(ops(s, d, "login_attempts"), now(), 2, 60 * 24), f"WITH a AS ({operations.ATTEMPTS}) SELECT username, count(*) AS n FROM a WHERE attempted_at > {NOW} - INTERVAL 1440 MINUTE AND attempted_at <= {NOW} GROUP BY username HAVING count(*) >= 2"))
    add("user_activity", (lambda s, d: usage.user_activity(ops(s, d, "users"), ops(s, d, "process_logs")), f"WITH u AS ({operations.USERS}), l AS ({operations.LOGS}) SELECT u.id, username, role, count(l.id) AS job_count, max(l.timestamp) AS last_active FROM u LEFT JOIN l ON l.user_id = u.id GROUP BY ALL"))
    add("jobs_view", (lambda s, d: usage.jobs_view(ops(s, d, "jobs"), ops(s, d, "users"), "queued").select("id", "user_id", "username", "status"), f"WITH u AS ({operations.USERS}), j AS ({operations.JOBS}) SELECT j.id, j.user_id, username, j.status FROM (SELECT * FROM j WHERE status = 'queued' ORDER BY created_at DESC, id DESC LIMIT 100) j LEFT JOIN u ON u.id = j.user_id"))
    add("search_logs", (lambda s, d: usage.search_logs(ops(s, d, "process_logs"), ops(s, d, "users"), None, "Success", "URGENT").select("id", "user_id", "username", "filename"), f"WITH u AS ({operations.USERS}), l AS ({operations.LOGS}) SELECT l.id, l.user_id, username, filename FROM (SELECT * FROM l WHERE status = 'Success' AND contains(lower(filename), 'urgent') ORDER BY timestamp DESC, id DESC LIMIT 200) l LEFT JOIN u ON u.id = l.user_id"))
    add("active_sessions", (lambda s, d: usage.active_sessions(ops(s, d, "login_tokens"), ops(s, d, "users"), now(), 7), f"WITH t AS ({operations.TOKENS}), u AS ({operations.USERS}) SELECT token_hash, user_id, username FROM t JOIN u ON u.id = t.user_id WHERE created_at > {NOW} - INTERVAL 7 DAY"))
    add("undelivered", (lambda s, d: usage.undelivered(ops(s, d, "jobs").selectExpr("id AS job_id", "CASE WHEN id % 3 = 0 THEN created_at END AS returned_at"), ops(s, d, "jobs")).select("job_id"), f"WITH j AS ({operations.JOBS}) SELECT id AS job_id FROM j WHERE id % 3 <> 0 AND status IN ('done', 'error')"))
    add("latest_attempts", (lambda s, d: usage.latest(ops(s, d, "login_attempts"), "attempted_at", 100, "username"), f"WITH a AS ({operations.ATTEMPTS}) SELECT * FROM a ORDER BY attempted_at DESC, username DESC LIMIT 100"))
    add("queue_order", (lambda s, d: usage.queue_order(ops(s, d, "jobs")).select("id", "created_at"), f"WITH j AS ({operations.JOBS}) SELECT id, created_at FROM j WHERE status = 'queued'"))
    add("usage_rollup", (lambda s, d: usage.usage_rollup(ops(s, d, "usage_calls")), f"WITH c AS ({operations.CALLS}) SELECT job_id, model, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, sum(cost_usd) AS cost_usd FROM c GROUP BY GROUPING SETS ((job_id, model), (job_id))"))
    guard_rows = f"WITH j AS ({operations.JOBS}), f AS (SELECT CAST(created_at AS DATE) AS date, id, concat('g', CAST(id % 6 AS STRING)) AS g FROM j WHERE status <> 'error' AND id % 11 <> 0)"
    add("daily_findings", (lambda s, d: usage.daily_findings(ops(s, d, "jobs")).select("date", "jobs", "failed", "for_the_author", F.array_join(F.array_sort(F.transform(F.map_entries("guard_findings"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), ",").alias("guards"), F.size("proofreading").alias("rules")), guard_rows + ", d AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS jobs, count(*) FILTER (status = 'error') AS failed FROM j GROUP BY 1), g AS (SELECT date, string_agg(concat(g, '=', CAST(n AS STRING)), ',' ORDER BY g) AS guards FROM (SELECT date, g, count(*) AS n FROM f GROUP BY ALL) GROUP BY date), a AS (SELECT date, count(*) FILTER (id % 2 = 0) AS n FROM f GROUP BY date) SELECT d.date, jobs, failed, coalesce(a.n, 0) AS for_the_author, coalesce(guards, '') AS guards, CAST(12 AS INTEGER) AS rules FROM d LEFT JOIN g ON d.date = g.date LEFT JOIN a ON d.date = a.date"))
    add("new_guards", (lambda s, d: usage.new_guards(usage.daily_findings(ops(s, d, "jobs").filter("day(created_at) % 2 = 0 OR id % 6 <> 2"))), guard_rows + ", k AS (SELECT date, list(DISTINCT g) AS g FROM f WHERE day(date) % 2 = 0 OR id % 6 <> 2 GROUP BY date), w AS (SELECT date, g, lag(g) OVER (ORDER BY date) AS was, row_number() OVER (ORDER BY date DESC) AS k FROM k) SELECT date, array_to_string(list_sort(list_filter(g, lambda x: was IS NOT NULL AND NOT list_contains(was, x))), ',') AS new FROM w WHERE k <= 14"))
    add("stalled", (lambda s, d: usage.stalled(ops(s, d, "jobs"), now()), f"WITH j AS ({operations.JOBS}) SELECT id, user_id FROM j WHERE status = 'running' AND coalesce(heartbeat_at, started_at) < {NOW} - INTERVAL 15 MINUTE"))
    add("enabled_rules", (lambda s, d: usage.enabled_rules(ops(s, d, "users"), ops(s, d, "users").filter("id % 4 = 0").selectExpr("id AS user_id", "array('heading', 'citation') AS disabled"), ["reference", "heading", "citation"]), "SELECT c_custkey AS user_id, g AS rule FROM customer, (SELECT unnest(['reference', 'heading', 'citation']) AS g) x WHERE NOT (c_custkey % 4 = 0 AND g IN ('heading', 'citation'))"))
    # recommendation
    add("recommend_topk", (lambda s, d: _top(s, d).select("doc_id", "cid", F.round("score", 6).alias("score"), "rank"), TOP_SQL + " SELECT doc_id, cid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 3"))
    add("rank_labels", (lambda s, d: recommend.explain_ranks(_top(s, d).join(_journals(s, d).select("cid", "impact_factor"), "cid")), TOP_SQL + ", n AS (SELECT *, lead(score) OVER (PARTITION BY doc_id ORDER BY rank) AS nxt FROM t WHERE rank <= 3) SELECT doc_id, CAST(rank AS INTEGER) AS rank, cid, CASE WHEN score >= 0.75 THEN 'strong' WHEN score >= 0.5 THEN 'good' WHEN score >= 0.35 THEN 'moderate' WHEN score > 0 THEN 'loose' ELSE 'fallback' END AS tier, CASE WHEN score >= 0.75 THEN 'Primary target' WHEN score >= 0.55 THEN 'Strong fit' WHEN score >= 0.4 THEN 'Reasonable fit' WHEN score > 0 THEN 'Worth considering' ELSE 'Fallback candidate' END AS fit, CASE WHEN nxt IS NULL OR score <= 0 OR nxt <= 0 THEN NULL WHEN score - nxt >= 0.1 THEN 'clearly ahead' WHEN score - nxt >= 0.03 THEN 'edges out' ELSE 'narrowly' END AS lead, CASE WHEN cid % 5 = 0 THEN NULL WHEN cid % 5 >= 3.5 THEN 'high' WHEN cid % 5 >= 2 THEN 'mid' ELSE 'modest' END AS impact FROM n"))
    add("domain_vote", (lambda s, d: recommend.detect_domain(_top(s, d), _journals(s, d)).select("doc_id", "domain", "agreed", "of"), TOP_SQL + ", v AS (SELECT doc_id, ['engineering', 'chemistry', 'law', 'computer & IT', 'life sciences'][cid % 5 + 1] AS domain, count(*) AS n, min(rank) AS seen FROM t WHERE rank <= 3 GROUP BY ALL) SELECT doc_id, arg_max(domain, n * 10 - seen) AS domain, max(n) AS agreed, CAST(sum(n) AS BIGINT) AS of FROM v GROUP BY doc_id"))
    add("candidate_pool", (lambda s, d: recommend.candidate_pool(_vectors(s, d), _journals(s, d)).select("doc_id", "cid", "prescreen", "place"), POOL_SQL + " SELECT doc_id, cid, prescreen, place FROM pool WHERE place <= 40"))
    add("gate_picks", (lambda s, d: _gated(_pool(s, d)), POOL_SQL + " SELECT doc_id, cid, name, fit FROM gated"))
    add("recommend_final", (lambda s, d: _fixed(_pool(s, d)), POOL_SQL + ", x AS (SELECT doc_id, cid, name, 0 AS how, -fit AS key FROM gated UNION ALL SELECT doc_id, cid, concat('Journal of Label ', CAST(cid AS STRING)), 1, place FROM pool WHERE place <= 40 AND place NOT IN (1, 2, 4)), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY how, key, cid) AS rank FROM x) SELECT doc_id, CAST(rank AS INTEGER) AS rank, cid, name FROM y WHERE rank <= 3"))
    add("originality", (lambda s, d: _flags(s, d).select("doc_id", "idx", "place", "n_sources", "sources"), None))
    add("originality_score", (lambda s, d: recommend.originality_score(corpus.paragraphs(docs(s, d)), _flags(s, d)), None))
    add("sample_sentences", (over(lambda p: recommend.sample_sentences(p).groupBy("doc_id").agg(F.count("*").alias("n"))), None))
    # layout
    add("dominant_font", (lambda s, d: layout.dominant(structure.table(s, d, structure.RUNS)), f"WITH x AS ({structure.duck(structure.RUNS)}), f AS (SELECT doc_id, idx, font_name, sum(length(text)) AS n FROM x GROUP BY ALL), g AS (SELECT doc_id, idx, font_size_pt, sum(length(text)) AS n FROM x GROUP BY ALL) SELECT a.doc_id, a.idx, a.font_name AS font, b.font_size_pt AS size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY n DESC, font_name) AS k FROM f) a JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY n DESC, font_size_pt) AS k FROM g) b ON a.doc_id = b.doc_id AND a.idx = b.idx AND a.k = 1 AND b.k = 1"))
    add("run_weight", (lambda s, d: layout.weight(structure.table(s, d, structure.RUNS)), f"WITH x AS ({structure.duck(structure.RUNS)}) SELECT doc_id, idx, CASE WHEN count(bold) > 0 THEN bool_and(coalesce(bold, false)) END AS bold, CASE WHEN count(italic) > 0 THEN bool_and(coalesce(italic, false)) END AS italic FROM x WHERE trim(text) <> '' GROUP BY ALL"))
    add("skipped_levels", (lambda s, d: layout.skipped_levels(structure.table(s, d, structure.FORMATS)), f"WITH x AS ({structure.duck(structure.FORMATS)}), l AS (SELECT doc_id, idx, outline_level + 1 AS level, lag(outline_level + 1) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM x WHERE outline_level IS NOT NULL) SELECT * FROM l WHERE level > before + 1"))
    add("heading_scan", (lambda s, d: layout.headings(structure.table(s, d, structure.FORMATS), layout.weight(structure.table(s, d, structure.RUNS))), None))
    add("listing_scan", (lambda s, d: layout.listings(structure.table(s, d, structure.FORMATS).withColumn("listing", F.when(F.col("num_id").isNotNull(), F.struct("num_id", F.lit(0).alias("level"), "kind", "house_code", "dot_suffix")))), f"WITH x AS ({structure.duck(structure.FORMATS)}), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, num_id ORDER BY idx) AS k FROM x WHERE num_id IS NOT NULL) SELECT * FROM (SELECT doc_id, idx, CASE WHEN kind = 'bullet' AND coalesce(house_code, '') NOT IN ('B1', 'B2', 'B3', 'B4') THEN 'listing.bullet' WHEN kind = 'number' AND coalesce(house_code, '') NOT IN ('N1', 'N2', 'N3') THEN 'listing.number' WHEN kind = 'number' AND NOT dot_suffix THEN 'listing.number-separator' END AS rule FROM k WHERE k = 1) t WHERE rule IS NOT NULL"))
    add("page_geometry", (lambda s, d: layout.page_geometry(structure.table(s, d, structure.SECTIONS)), f"WITH x AS ({structure.duck(structure.SECTIONS)}) SELECT doc_id, section_no, 'width_in' AS side, width_in AS got FROM x WHERE abs(width_in - 8.27) > 0.02 UNION ALL SELECT doc_id, section_no, 'left_in', left_in FROM x WHERE abs(left_in - 1.0) > 0.02 UNION ALL SELECT doc_id, section_no, 'bottom_in', bottom_in FROM x WHERE abs(bottom_in - 0.5) > 0.02"))
    add("artwork_size", (lambda s, d: layout.artwork(structure.table(s, d, structure.IMAGES)), f"WITH i AS ({structure.duck(structure.IMAGES)}) SELECT doc_id, image_no, 'artwork.size' AS rule FROM i WHERE in_w > 9.01 OR in_h > 6.01"))
    add("table_captions", (lambda s, d: layout.table_captions(structure.table(s, d, structure.TABLES), manuscripts(s, d).withColumn("text", F.when(F.col("idx") % 2 == 0, F.concat(F.lit("Table 1. "), "text")).otherwise(F.col("text")))), None))
    add("table_notes", (lambda s, d: layout.table_notes(structure.table(s, d, structure.TABLES), structure.table(s, d, structure.FORMATS).withColumn("text", F.concat(F.lit("Note: "), "text")).join(layout.dominant(structure.table(s, d, structure.RUNS)), ["doc_id", "idx"])), f"WITH t AS ({structure.duck(structure.TABLES)}) SELECT t.doc_id, t.table_no, q.idx FROM t JOIN p q ON q.doc_id = t.doc_id AND q.idx > after_idx AND q.idx <= after_idx + 3 WHERE length(q.text) > 0"))
    add("body_text", (lambda s, d: layout.body_text(manuscripts(s, d), structure.table(s, d, structure.FORMATS).withColumn("listing", F.col("num_id")), layout.dominant(structure.table(s, d, structure.RUNS))), None))
    add("reference_layout", (lambda s, d: layout.reference_layout(refs_of(s, d), structure.table(s, d, structure.FORMATS), layout.dominant(structure.table(s, d, structure.RUNS))), None))
    add("front_matter", (lambda s, d: layout.front_matter(manuscripts(s, d), layout.dominant(structure.table(s, d, structure.RUNS))), None))
    add("table_cells", (lambda s, d: layout.table_cell_rollup(structure.table(s, d, structure.CELLS).withColumn("size", F.col("size").cast("double"))), None))
    add("layout_collapse", (lambda s, d: layout.collapse_layout(manuscripts(s, d).selectExpr("doc_id", "idx", "'table.margin' AS rule", "concat('table ', CAST(idx AS STRING), ' left margin is 0.03 in section ', CAST(idx % 2 AS STRING)) AS message")), "SELECT doc_id, 'table.margin' AS rule, 'table N left margin is 0.03 in section N' AS key, count(*) AS n, min(idx) AS first_idx, 'table 0 left margin is 0.03 in section 0' AS message FROM p GROUP BY doc_id"))
    add("cells_lettered", (lambda s, d: cells_of.cells(structure.table(s, d, structure.CELLS), "lettered").groupBy("doc_id").agg(F.count("*").alias("n")), f"WITH c AS ({structure.duck(structure.CELLS)}) SELECT doc_id, count(*) AS n FROM c WHERE regexp_matches(text, '\\p{{L}}') GROUP BY doc_id"))
    add("cells_readable", (lambda s, d: cells_of.cells(structure.table(s, d, structure.CELLS), "readable").groupBy("doc_id").agg(F.count("*").alias("n")), f"WITH c AS ({structure.duck(structure.CELLS)}) SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, table_no, text FROM c WHERE regexp_matches(text, '[A-Za-z]{{4,}}')) t GROUP BY doc_id"))
    # whole jobs
    add("proofread_scan", (over(lambda p: jobs.proofread_scan(p).groupBy("rule").agg(F.count("*").alias("n"))), None))
    add("layout_scan", (lambda s, d: jobs.layout_scan(manuscripts(s, d), structure.table(s, d, structure.FORMATS).withColumn("listing", F.col("num_id")), *[structure.table(s, d, t) for t in (structure.RUNS, structure.TABLES, structure.SECTIONS, structure.IMAGES)]).groupBy("rule").agg(F.count("*").alias("n")), None))
    add("rewrite_job", (over(lambda p: jobs.house_rewrite(p, {"citation"}).groupBy("doc_id").agg(F.count("*").alias("n"))), None))
    add("domain_job", (lambda s, d: jobs.recommendations(_vectors(s, d), _journals(s, d))["domains"].select("doc_id", "domain", "agreed", "of"), POOL_SQL + ", v AS (SELECT doc_id, ['engineering', 'chemistry', 'law', 'computer & IT', 'life sciences'][cid % 5 + 1] AS domain, count(*) AS n, min(place) AS seen FROM pool WHERE place <= 3 GROUP BY ALL) SELECT doc_id, arg_max(domain, n * 10 - seen) AS domain, max(n) AS agreed, CAST(sum(n) AS BIGINT) AS of FROM v GROUP BY doc_id"))
    add("routine_job", (lambda s, d: jobs.corpus_reports(scans.mechanical(manuscripts(s, d)), docs(s, d))["marked"].groupBy("rule", "routine").agg(F.count("*").alias("n")), _FOUND + " SELECT rule, count(DISTINCT doc_id) / (SELECT count(*) FROM documents) > 0.55 AS routine, CAST(sum(n) AS BIGINT) AS n FROM f WHERE n > 0 GROUP BY rule"))
    add("number_losses", (over_r(lambda r: r.filter("original <> edited").select("doc_id", "idx", F.array_join(texts.array_lost(texts.numbers(texts.sanctioned(F.col("original"))), texts.numbers(texts.sanctioned(F.col("edited")))), ",").alias("lost")).filter("lost <> ''")), None))
    add("reset_days", (lambda s, d: ops(s, d, "process_logs").select(F.to_date("timestamp").alias("day")).distinct().select("day", texts.resets_on(F.col("day")).alias("resets_on")), f"WITH l AS ({operations.LOGS}) SELECT DISTINCT CAST(timestamp AS DATE) AS day, CAST(date_trunc('month', timestamp) + INTERVAL 1 MONTH AS DATE) AS resets_on FROM l"))
    add("name_overlap", (lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.round(texts.dice(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring"))), 6).alias("dice"), texts.slug(F.col("p_type")).alias("slug")), "SELECT p_partkey, round(2.0 * len(list_intersect(string_split(p_name, ' '), ['red', 'ring'])) / (len(list_distinct(string_split(p_name, ' '))) + 2), 6) AS dice, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part"))
    return q


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return {name: with_views(sql or SQL[name]) for name, (_, sql) in queries().items() if sql or name in SQL}
