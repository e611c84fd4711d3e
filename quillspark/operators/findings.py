"""Findings of all families: union, summaries, prevalence, collapsing, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rules for authors, rules that repeat, and the order of an author's report.
AUTHOR_RULES = ("acronym.used_before_definition", "reference.no_caption", "references.incomplete", "caption.not_cited")
REPEATING = ("space.double", "dash.range", "unit.spacing", "space.before-punctuation", "space.after-punctuation")


def all_findings(*families: DataFrame) -> DataFrame:
    """SO-2: findings of all families; columns that a family lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)


def summarise(findings: DataFrame) -> DataFrame:
    """AG-8: (doc_id, rule, severity, n): counts by rule, by severity and in all; the other columns are null."""
    # counted once first, so that each finding isn't expanded threefold
    each = findings.groupBy("doc_id", "rule", "severity").agg(F.count("*").alias("n"))
    return each.groupingSets([["doc_id", "rule"], ["doc_id", "severity"], ["doc_id"]], "doc_id", "rule", "severity").agg(F.sum("n").alias("n"))


def prevalence(findings: DataFrame, documents: DataFrame, routine: float = 0.55) -> DataFrame:
    """AG-9: (rule, docs, share, routine): the share of documents in which a rule fires.

    Documents are counted by rule and document first, so no rule's documents meet in one task.
    """
    total = documents.agg(F.count("*").alias("total"))
    per = findings.groupBy("rule", "doc_id").agg(F.lit(1).alias("one")).groupBy("rule").agg(F.count("*").alias("docs"))
    both = per.join(F.broadcast(total))  # one row
    return both.select("rule", "docs", F.round(F.col("docs") / F.col("total"), 6).alias("share"), (F.col("docs") / F.col("total") > routine).alias("routine"))


def split_routine(findings: DataFrame, rates: DataFrame) -> DataFrame:
    """FIL-9: findings with `routine`, from the measured rates (one row for each rule)."""
    return findings.join(F.broadcast(rates.select("rule", "routine")), "rule", "left").withColumn("routine", F.coalesce("routine", F.lit(False)))


def for_audience(findings: DataFrame, audience: str) -> DataFrame:
    """FIL-8: findings for the author, or all others for the house."""
    mine = F.col("rule").isin(*AUTHOR_RULES)
    return findings.filter(mine if audience == "author" else ~mine)


def collapse_repeats(findings: DataFrame, keep: int = 3) -> DataFrame:
    """WN-5: (doc_id, rule, idx, n): repeating rules keep their first `keep` places; the rest is one row with its count, at the next place."""
    order = Window.partitionBy("doc_id", "rule").orderBy("idx", "fragment")
    ranked = findings.withColumn("k", F.when(F.col("rule").isin(*REPEATING), F.row_number().over(order)).otherwise(0))
    kept = ranked.filter(F.col("k") <= keep).select("doc_id", "rule", "idx", F.lit(1).cast("bigint").alias("n"))
    rest = ranked.filter(F.col("k") > keep).groupBy("doc_id", "rule").agg(F.min("idx").alias("idx"), F.count("*").alias("n"))
    return kept.union(rest.select("doc_id", "rule", "idx", "n"))


def author_gaps(findings: DataFrame) -> DataFrame:
    """AG-31: (doc_id, place, rule, n): what an author has to supply, in the order of the rules, equal rules collapsed."""
    place = F.coalesce(*[F.when(F.col("rule") == r, F.lit(i)) for i, r in enumerate(AUTHOR_RULES)])
    mine = findings.filter(F.col("rule").isin(*AUTHOR_RULES)).dropDuplicates(["doc_id", "rule", "fragment"])
    return mine.groupBy("doc_id", place.alias("place"), "rule").agg(F.count("*").alias("n"))


def report_rows(findings: DataFrame, samples: int = 5) -> DataFrame:
    """AG-32: (doc_id, rule, n, first_idx, samples): a report's rows, at most `samples` fragments each, limited before the shuffle."""
    n = findings.groupBy("doc_id", "rule").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    order = Window.partitionBy("doc_id", "rule").orderBy("idx", "fragment")
    few = findings.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= samples)
    shown = few.groupBy("doc_id", "rule").agg(F.array_sort(F.collect_list(F.struct("k", "fragment"))).alias("s")).select("doc_id", "rule", F.transform("s", lambda x: x["fragment"]).alias("samples"))
    return n.join(shown, ["doc_id", "rule"])


def cap_per_doc(df: DataFrame, n: int, *order: str) -> DataFrame:
    """TK-5: the first n rows of each document (a lookup budget)."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter(F.col("k") <= n).drop("k")
