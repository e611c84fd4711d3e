"""Paragraph and revision tables of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(table: DataFrame) -> DataFrame:
    """A table of files dealt over all cores, if it is so small that a scan would leave some idle; larger ones have splits enough and stay as they are."""
    spark = table.sparkSession
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else table


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, idx, text): every line of a document keeps its place, blank ones too; a null text has none."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))


def pair(original: DataFrame, edited: DataFrame) -> DataFrame:
    """Revisions: paragraphs of two versions that share document and place; what only one has is left out."""
    return original.select("doc_id", "idx", F.col("text").alias("original")).join(edited.select("doc_id", "idx", F.col("text").alias("edited")), ["doc_id", "idx"])


def unpaired(original: DataFrame, edited: DataFrame) -> DataFrame:
    """(doc_id, only_original, only_edited): paragraphs that the other version lacks, for documents that have any."""
    both = original.select("doc_id", "idx", F.lit(1).alias("a")).join(edited.select("doc_id", "idx", F.lit(1).alias("b")), ["doc_id", "idx"], "full_outer")
    counts = both.groupBy("doc_id").agg(F.count(F.when(F.col("b").isNull(), 1)).alias("only_original"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_edited"))
    return counts.filter("only_original > 0 OR only_edited > 0")


def zones(p: DataFrame) -> DataFrame:
    """p with `zone`: front, abstract, body or references, from the first heading of each kind in its document."""
    folded = F.lower(F.regexp_replace(F.trim("text"), r"^[\d.\s]+|[:.\-–—\s]+$", ""))
    # few paragraphs name a heading at all; the rest skip the costly pattern and the aggregate
    named = p.filter(F.col("text").rlike("(?i)abstract|introduction|background|reference|bibliography"))
    marks = named.groupBy("doc_id").agg(
        F.min(F.when(folded == "abstract", F.col("idx"))).alias("abstract_at"),
        F.min(F.when(folded.isin("introduction", "background"), F.col("idx"))).alias("body_at"),
        F.min(F.when(folded.rlike("^(list of )?references?$|^bibliography$"), F.col("idx"))).alias("references_at"),
    )
    zone = (
        F.when(F.col("idx") >= F.col("references_at"), "references")
        .when(F.col("idx") >= F.col("body_at"), "body")
        .when((F.col("idx") >= F.col("abstract_at")) & F.col("body_at").isNotNull(), "abstract")
        .when(F.col("body_at").isNull(), "body")
        .otherwise("front")
    )
    return p.join(marks, "doc_id", "left").select("doc_id", "idx", "text", zone.alias("zone"))


def chunks(p: DataFrame, size: int = 5) -> DataFrame:
    """p's non-blank paragraphs with the number of their chunk of `size` in the document."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("idx")
    filled = p.filter(F.trim("text") != "")
    return filled.withColumn("place", F.row_number().over(order) - 1).select("doc_id", "idx", "text", F.expr(f"cast(place div {size} as int)").alias("chunk"), F.expr(f"place % {size}").alias("pos"))
