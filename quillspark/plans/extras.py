"""Registered queries of sources and sinks: packages, the catalogue and written tables, all derived from the given tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings, recommend, scans, usage
from ..sources import catalogue, packages, sinks
from . import streams
from .planting import manuscripts, revisions, with_views

SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
#: Characters that XML can't hold; a space stands for them.
NO_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"


def packed(rows: DataFrame, parts: Column | None = None) -> DataFrame:
    """(path, length, content): a Word package for each document of paragraphs (doc_id, idx, xml), and with the members of their column `parts`, if there is one.

    parts: members of every package, array<struct<name, data>> over doc_id.
    """

    def rows_of(batch: pd.DataFrame) -> Iterator[tuple]:
        for doc_id, body, parts in zip(batch["doc_id"], batch["body"], batch["parts"], strict=True):
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", f"<w:document {SPACE}><w:body>{body}</w:body></w:document>")
                for part in parts:
                    z.writestr(part["name"], bytes(part["data"]))
            yield f"store/paper-{doc_id}.docx", len(data.getvalue()), data.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from packages.in_pieces(rows_of(batch), ["path", "length", "content"])

    kind = "array<struct<name:string,data:binary>>"
    own = F.flatten(F.collect_list("parts")) if "parts" in rows.columns else F.array().cast(kind)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "xml"))), lambda x: x["xml"]), "")
    per = rows.groupBy("doc_id").agg(body.alias("body"), own.alias("parts"))
    if parts is not None:
        per = per.withColumn("parts", F.concat("parts", parts.cast(kind)))
    return per.mapInPandas(run, "path string, length long, content binary")


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def clean(column: str) -> Column:
    return F.regexp_replace(column, NO_XML, " ")


def package_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2, SRC-2b: the manuscripts as packages, read back."""
    xml = F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), _escaped(clean("text")), F.lit("</w:t></w:r></w:p>"))
    made = packed(manuscripts(spark, d).select("doc_id", "idx", xml.alias("xml")))
    return packages.by_document(packages.tables_of(made)["paragraphs"])


def tracked_revisions(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3: the revisions as tracked changes, read back."""
    was, now = _escaped(clean("original")), _escaped(clean("edited"))
    xml = F.concat(F.lit("<w:p><w:del><w:r><w:delText>"), was, F.lit("</w:delText></w:r></w:del><w:ins><w:r><w:t>"), now, F.lit("</w:t></w:r></w:ins></w:p>"))
    made = packed(revisions(spark, d).select("doc_id", "idx", xml.alias("xml")))
    return packages.by_document(packages.revisions_from_tracked(made))


#: First bytes that other kinds of files have, by doc_id % 9 from 3 on, and what they are.
OTHERS = (("255044462D312E37", "PDF"), ("D0CF11E0A1B11AE1", "old Word"), ("7B5C72746631", "RTF"), ("3C3F786D6C20", "XML"), ("3C21444F4354595045", "HTML"), ("00010203", "not an Office file"))


def package_triage(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4: the manuscripts' packages, of which some are cut, empty, or of another kind."""
    xml = F.concat(F.lit("<w:p><w:r><w:t>"), _escaped(clean("text")), F.lit("</w:t></w:r></w:p>"))
    made = packed(manuscripts(spark, d).select("doc_id", "idx", xml.alias("xml")))
    number = F.regexp_extract("path", r"(\d+)\.docx", 1).cast("bigint") % 9
    content = F.when(number == 1, F.substring("content", 1, 40)).when(number == 2, F.lit("").cast("binary"))
    for k, (first, _) in enumerate(OTHERS, 3):
        content = content.when(number == k, F.concat(F.unhex(F.lit(first)), F.col("content")))
    changed = made.select("path", content.otherwise(F.col("content")).alias("content")).withColumn("length", F.length("content").cast("bigint"))
    return packages.by_document(packages.triage_files(changed))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{sinks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def sink_daily(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1: all days written, then every second one again with new counts."""
    days = spark.read.parquet(f"{d}/events.parquet").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    path = _folder(spark, "daily")
    sinks.write_daily(days, path)
    sinks.write_daily(days.filter("day(date) % 2 = 0").withColumn("n", F.col("n") + 1), path)
    return sinks.read_daily(spark, path, "date date, n long").select("date", "n")


def sink_findings(spark: SparkSession, d: str) -> DataFrame:
    """SNK-2: findings by family, counted from the written table."""
    p = manuscripts(spark, d)
    found = scans.doubled_words(p).withColumn("family", F.lit("words")).unionByName(scans.unbalanced_quotes(p).withColumn("family", F.lit("marks")))
    path = _folder(spark, "findings")
    sinks.write_findings(found, path)
    return spark.read.parquet(path).groupBy("doc_id", "family", "rule").agg(F.count("*").alias("n"), F.min("paragraph").cast("int").alias("first"))


def sink_retained(spark: SparkSession, d: str) -> DataFrame:
    """SNK-3: the events that ten days of retention leave."""
    kept = sinks.retain(spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", 10, F.lit("2024-01-25 00:00:00").cast("timestamp"))
    return kept.select("event_id")


def sink_upserts(spark: SparkSession, d: str) -> DataFrame:
    """SNK-4: the last event of each user, upserted by a stream."""
    path = _folder(spark, "upserts")
    stream = streams.events(spark, d).select("user_id", "ts", "event_id")
    query = stream.writeStream.foreachBatch(sinks.upsert_stream(path, "user_id", "event_id")).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("user_id long, event_id long").parquet(path).select("user_id", "event_id")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """SO-5: customers of whom every third has a new balance."""
    old = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("v"))
    return sinks.upsert(old, old.filter("c_custkey % 3 = 0").withColumn("v", F.col("v") + 100), "c_custkey")


def _catalogue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as a listing of journals: every third fetch failed, every second journal is in the previous catalogue."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    name = F.concat(F.lit("Journal  of "), F.col("k").cast("string"))
    listing = s.select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("code"), name.alias("title"), F.when(F.col("k") % 2 == 0, "Law").otherwise("").alias("domain"))
    details = s.filter("k % 3 <> 0").select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("code"), F.concat(F.lit("Journal of "), F.col("k").cast("string")).alias("title"), F.array(F.lit("a"), F.lit("b")).alias("subject_areas"), F.repeat(F.lit("s"), F.col("k").cast("int") % 300).alias("scope"), F.lit("P").alias("publisher_name"))
    previous = s.filter("k % 2 = 0").select(F.concat(F.lit("journal OF "), F.col("k").cast("string")).alias("name"), F.lit("old").alias("scope"), F.array(F.lit("z")).alias("subject_areas"), F.lit("Q").alias("publisher"), F.col("k").cast("double").alias("impact_factor"))
    return catalogue.refresh_catalogue(listing, details, previous)


def catalogue_refresh(spark: SparkSession, d: str) -> DataFrame:
    """SRC-9: the refreshed catalogue's rows."""
    return _catalogue(spark, d)[0].select("code", "name", F.array_join("topics", ",").alias("topics"), F.array_join("subject_areas", ",").alias("areas"), F.length("scope").alias("scope_chars"), "publisher", "impact_factor")


def catalogue_audit(spark: SparkSession, d: str) -> DataFrame:
    """SRC-9: what was fetched, carried and lost."""
    return _catalogue(spark, d)[1]


def catalogue_profile(spark: SparkSession, d: str) -> DataFrame:
    """AG-33: the catalogue in figures."""
    return catalogue.catalogue_stats(_catalogue(spark, d)[0])


def catalogue_texts(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10: what of each journal is embedded."""
    return recommend.journal_text(_catalogue(spark, d)[0].withColumn("cid", F.col("code")))


def usage_costs(spark: SparkSession, d: str) -> DataFrame:
    """Costs as readers see them; users without a purchase have none reported."""
    spent = F.sum(F.when(F.col("event_type") == "purchase", (F.col("event_id") % 4000).cast("double") / 16))
    return spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(usage.format_cost(spent).alias("cost"))


def lookup_budget(spark: SparkSession, d: str) -> DataFrame:
    """TK-5: the first five doubled words of each document."""
    return findings.cap_per_doc(scans.doubled_words(manuscripts(spark, d)).select("doc_id", "idx", "suggestion").distinct(), 5, "idx", "suggestion").select("doc_id", "idx", "suggestion")


CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
DOUBLED = r"(?i)\b(?:the\s+the|of\s+of|and\s+and|is\s+is|in\s+in)\b"
ASCII = "regexp_replace(text, '[À-ɏ]', 'x', 'g')"
MADE = """s AS (SELECT s_suppkey AS k FROM supplier), m AS (SELECT k, k % 3 <> 0 AS fetched, k % 2 = 0 AS known FROM s)"""
ROWS = f"""WITH {MADE} SELECT concat('c', CAST(k AS STRING)) AS code, concat(CASE WHEN fetched THEN 'Journal of ' ELSE 'Journal  of ' END, CAST(k AS STRING)) AS name, CASE WHEN k % 2 = 0 THEN 'Law' ELSE '' END AS topics,
  CASE WHEN fetched THEN 'a,b' ELSE 'z' END AS areas, CAST(CASE WHEN fetched THEN k % 300 ELSE 3 END AS INTEGER) AS scope_chars, CASE WHEN fetched THEN 'P' ELSE 'Q' END AS publisher, CASE WHEN known THEN CAST(k AS DOUBLE) END AS impact_factor FROM m WHERE fetched OR known"""

SQL = {
    "package_paragraphs": f"SELECT doc_id, idx, regexp_replace(text, '{CONTROL}', ' ', 'g') AS text FROM p",
    "tracked_revisions": f"SELECT doc_id, idx, regexp_replace(original, '{CONTROL}', ' ', 'g') AS original, regexp_replace(edited, '{CONTROL}', ' ', 'g') AS edited FROM r",
    "package_triage": f"SELECT doc_id, doc_id % 9 = 0 AS ok, CASE doc_id % 9 WHEN 1 THEN 'damaged' WHEN 2 THEN 'empty' {' '.join(f"WHEN {k} THEN '{what}'" for k, (_, what) in enumerate(OTHERS, 3))} END AS reason FROM (SELECT DISTINCT doc_id FROM p) q",
    "sink_daily": "SELECT CAST(ts AS DATE) AS date, count(*) + CASE WHEN day(CAST(ts AS DATE)) % 2 = 0 THEN 1 ELSE 0 END AS n FROM events GROUP BY CAST(ts AS DATE)",
    "sink_findings": f"WITH f AS (SELECT doc_id, idx, 'words' AS family, 'word.doubled' AS rule, len(regexp_extract_all({ASCII}, '{DOUBLED}')) AS k FROM p UNION ALL SELECT doc_id, idx, 'marks', 'punctuation.unbalanced-quotes', (len(regexp_extract_all(text, '“')) <> len(regexp_extract_all(text, '”')))::INT FROM p) SELECT doc_id, family, rule, CAST(sum(k) AS BIGINT) AS n, min(idx) + 1 AS first FROM f WHERE k > 0 GROUP BY ALL",
    "sink_retained": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 10 DAY",
    "sink_upserts": "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id",
    "upserted": "SELECT c_custkey, CAST(c_nationkey AS BIGINT) + CASE WHEN c_custkey % 3 = 0 THEN 100 ELSE 0 END AS v FROM customer",
    "catalogue_refresh": ROWS,
    "catalogue_audit": f"WITH {MADE} SELECT count(*) FILTER (fetched) AS fetched, count(*) FILTER (NOT fetched AND known) AS carried, count(*) FILTER (NOT fetched AND NOT known) AS lost, count(*) FILTER (NOT fetched AND NOT known) = 0 AS complete FROM m",
    "catalogue_profile": f"SELECT count(*) AS journals, CAST(sum(scope_chars) AS BIGINT) AS scope_chars, round(avg(len(string_split(areas, ','))), 6) AS areas_each, count(impact_factor) AS with_impact, count(*) FILTER (scope_chars < 200 AND len(string_split(areas, ',')) < 3) AS thin FROM ({ROWS}) c",
    "catalogue_texts": f"WITH {MADE} SELECT concat('c', CAST(k AS STRING)) AS cid, concat_ws(' ', CASE WHEN fetched THEN concat('Journal of ', k) ELSE concat('Journal  of ', k) END, CASE WHEN fetched THEN 'a b' ELSE 'z' END, CASE WHEN k % 2 = 0 THEN 'Law' ELSE '' END, CASE WHEN fetched THEN repeat('s', k % 300) ELSE 'old' END) AS text FROM m WHERE fetched OR known",
    "usage_costs": "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'not reported' ELSE concat('$', format('{:,.4f}', sum(CASE WHEN event_type = 'purchase' THEN CAST(event_id % 4000 AS DOUBLE) / 16 END))) END AS cost FROM events GROUP BY user_id",
    "lookup_budget": f"WITH f AS (SELECT DISTINCT doc_id, idx, regexp_extract(m, '^\\w+') AS suggestion FROM (SELECT doc_id, idx, unnest(regexp_extract_all({ASCII}, '{DOUBLED}')) AS m FROM p) x), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, suggestion) AS k FROM f) SELECT doc_id, idx, suggestion FROM k WHERE k <= 5",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (package_paragraphs, tracked_revisions, package_triage, sink_daily, sink_findings, sink_retained, sink_upserts, upserted, catalogue_refresh, catalogue_audit, catalogue_profile, catalogue_texts, usage_costs, lookup_budget)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) if " FROM p" in sql or " FROM r" in sql else sql for name, sql in SQL.items()}
