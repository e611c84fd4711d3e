"""Word-level changes between two versions of a paragraph."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPANS = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("op", "old", "new")]))


@F.pandas_udf(_SPANS)
def aligned(before: pd.Series, after: pd.Series) -> pd.Series:
    """UDF-1: the word alignment of two texts: same, del, ins and replace spans in order.

    The matching is the sequence matcher of the standard library, whose heuristics
    have no SQL form; it sees changed paragraphs only.
    """

    def one(a: str, b: str) -> list[dict]:
        left, right = re.findall(r"\S+\s*", a or ""), re.findall(r"\S+\s*", b or "")
        names = {"equal": "same", "delete": "del", "insert": "ins", "replace": "replace"}
        return [{"op": names[t], "old": "".join(left[i:j]), "new": "".join(right[k:m])} for t, i, j, k, m in difflib.SequenceMatcher(None, left, right).get_opcodes()]

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)])


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The sequence matcher's ratio of two words."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def spans(r: DataFrame) -> DataFrame:
    """(doc_id, idx, spans) of changed paragraphs; unchanged ones never reach Python."""
    return r.filter("original <> edited").select("doc_id", "idx", aligned("original", F.coalesce("edited", F.lit(""))).alias("spans"))


def change_pairs(r: DataFrame, least: int = 2, most: int = 60) -> DataFrame:
    """(doc_id, idx, old, new): replaced words, both sides of `least` to `most` characters."""
    each = spans(r).select("doc_id", "idx", F.explode(F.filter("spans", lambda s: s["op"] == "replace")).alias("s"))
    return each.select("doc_id", "idx", F.trim("s.old").alias("old"), F.trim("s.new").alias("new")).filter(F.length("old").between(least, most) & F.length("new").between(least, most))


def group_changes(pairs: DataFrame, least: int = 3, limit: int = 12, paragraphs: int = 12) -> DataFrame:
    """(doc_id, rank, old, new, n, places): substitutions made `least` times or more, first letters folded, the commonest spelling shown; a report of `limit` rows."""
    fold = lambda c: F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    keyed = pairs.withColumn("a", fold(F.col("old"))).withColumn("b", fold(F.col("new"))).filter("a <> b")
    spelled = keyed.groupBy("doc_id", "a", "b", "old", "new").agg(F.count("*").alias("m"), F.min("idx").alias("seen"), F.collect_set("idx").alias("at"))
    best = F.max_by(F.struct("old", "new"), F.struct("m", -F.col("seen")))
    grouped = spelled.groupBy("doc_id", "a", "b").agg(F.sum("m").alias("n"), best.alias("shown"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("places")).filter(F.col("n") >= least)
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "shown.old", "a", "b")
    ranked = grouped.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("doc_id", "rank", "shown.old", "shown.new", "n", F.slice("places", 1, paragraphs).alias("places"))


def recurring_changes(r: DataFrame) -> DataFrame:
    """AG-16: the same change, made over and over, once with its count."""
    return group_changes(change_pairs(r))


def chunk_edits(r: DataFrame, size: int = 5, most: int = 4) -> DataFrame:
    """TK-6: (doc_id, chunk, k, idx, summary, spans): the first changed paragraphs of each chunk, with the first change in a line."""
    numbered = r.filter("trim(original) <> ''").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")) - 1).withColumn("chunk", F.expr(f"cast(place div {size} as int)"))
    few = numbered.filter("trim(original) <> trim(edited)").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "chunk").orderBy("idx"))).filter(F.col("k") <= most)
    shown = few.select("doc_id", "chunk", "k", "idx", aligned("original", "edited").alias("spans"))
    first = F.element_at(F.filter("spans", lambda s: s["op"] != "same"), 1)
    cut = lambda c: F.when(F.length(F.trim(c)) > 70, F.concat(F.left(F.trim(c), F.lit(70)), F.lit("…"))).otherwise(F.trim(c))
    summary = F.when(first["op"] == "ins", F.concat(F.lit("added “"), cut(first["new"]), F.lit("”"))).when(first["op"] == "del", F.concat(F.lit("removed “"), cut(first["old"]), F.lit("”"))).otherwise(F.concat(F.lit("“"), cut(first["old"]), F.lit("” → “"), cut(first["new"]), F.lit("”")))
    return shown.select("doc_id", "chunk", "k", "idx", summary.alias("summary"), "spans")


def salvage(r: DataFrame, same_word: float = 0.75) -> DataFrame:
    """G-14: (doc_id, idx, text): the author's paragraph with the edit's one-word spelling corrections, for paragraphs the edit shortened."""
    flagged = r.filter("original <> edited AND length(trim(original)) >= 120 AND length(edited) < 0.7 * length(original) AND trim(edited) <> ''")
    each = spans(flagged).select("doc_id", "idx", F.posexplode("spans").alias("at", "s"))
    core = lambda c: F.regexp_replace(F.trim(c), r"^\W+|\W+$", "")
    old, new = core(F.col("s.old")), core(F.col("s.new"))
    single = (F.col("s.op") == "replace") & old.rlike("^[A-Za-z]+$") & new.rlike("^[A-Za-z]+$") & (F.lower(old) != F.lower(new)) & ~F.trim("s.old").rlike(r"\s")
    judged = each.withColumn("close", F.when(single, likeness(F.lower(old), F.lower(new)))).filter("s.op <> 'ins'")
    piece = F.when(F.col("close") >= same_word, F.replace(F.col("s.old"), old, new)).otherwise(F.col("s.old"))
    put = judged.select("doc_id", "idx", F.struct("at", piece.alias("piece")).alias("p")).groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return put.select("doc_id", "idx", F.array_join(F.transform("ps", lambda x: x["piece"]), "").alias("text"))


def change_counts(r: DataFrame) -> DataFrame:
    """AG-27: (doc_id, paragraphs, insertions, deletions) of each document's changed paragraphs."""
    count = lambda *ops: F.size(F.filter("spans", lambda s: s["op"].isin(*ops)))
    return spans(r).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(count("ins", "replace")).alias("insertions"), F.sum(count("del", "replace")).alias("deletions"))


def realign_chunks(p: DataFrame, output: DataFrame, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """JN-27: revisions and skipped paragraphs: a chunk's output (doc_id, chunk, pos, edited) counts only if it has as many items as the chunk."""
    from ..sources.corpus import chunks

    mine = chunks(p, size)
    want = mine.groupBy("doc_id", "chunk").agg(F.count("*").alias("want"))
    got = output.groupBy("doc_id", "chunk").agg(F.count("*").alias("got"))
    fit = want.join(got, ["doc_id", "chunk"], "left").select("doc_id", "chunk", F.coalesce(F.col("want") == F.col("got"), F.lit(False)).alias("fit"))
    both = mine.join(fit, ["doc_id", "chunk"]).join(output.withColumnRenamed("edited", "new"), ["doc_id", "chunk", "pos"], "left")
    revised = both.select("doc_id", "idx", F.col("text").alias("original"), F.when(F.col("fit"), F.coalesce("new", "text")).otherwise(F.col("text")).alias("edited"))
    return revised, both.filter("NOT fit").select("doc_id", "idx", "chunk")


def verify_model_findings(raw: DataFrame, p: DataFrame) -> DataFrame:
    """JN-26: findings (doc_id, idx, problem, fragment) whose fragment stands in their paragraph; a claim that something is never defined falls if an earlier paragraph defines it."""
    real = raw.filter("trim(problem) <> '' AND trim(fragment) <> ''").join(p, ["doc_id", "idx"]).filter(F.contains("text", "fragment"))
    keyed = real.withColumn("acronym", F.when(F.lower("problem").rlike("never defined|not defined|undefined"), F.regexp_extract("fragment", r"\b([A-Z]{2,6})\b", 1)))
    defined = p.select("doc_id", F.col("idx").alias("at"), F.explode(F.regexp_extract_all("text", F.lit(r"\(([A-Z]{2,6})s?\)"), F.lit(1))).alias("short"))
    d = defined.withColumnRenamed("doc_id", "d")
    refuted = (F.col("doc_id") == F.col("d")) & (F.col("acronym") == F.col("short")) & (F.col("at") < F.col("idx"))
    return keyed.join(d, refuted, "left_anti").select("doc_id", "idx", "problem", "fragment")


def review_summary(r: DataFrame, answers: DataFrame) -> DataFrame:
    """AG-28: (doc_id, asked, accepted, rejected): answers (doc_id, idx, decision, ts), the last one counts; what nobody answered is accepted."""
    last = answers.groupBy("doc_id", "idx").agg(F.max_by("decision", "ts").alias("decision"))
    both = r.filter("original <> edited").join(last, ["doc_id", "idx"], "left")
    rejected = F.count(F.when(F.col("decision") == "reject", 1))
    return both.groupBy("doc_id").agg(F.count("*").alias("asked"), (F.count("*") - rejected).alias("accepted"), rejected.alias("rejected"))
