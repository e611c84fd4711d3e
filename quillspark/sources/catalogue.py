"""The journal catalogue: scan, refresh, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNALS = "cid int, name string, code string, topics array<string>, subject_areas array<string>, scope string, publisher string, impact_factor double, embedding array<float>"


def journals(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: the catalogue from JSON with its declared schema."""
    return spark.read.schema(JOURNALS).json(path, multiLine=True)


def name_key(column: str):
    return F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))


def refresh_catalogue(listing: DataFrame, details: DataFrame, previous: DataFrame, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """SRC-9: journals and an audit: new rows with impact factors carried by normalised name; a failed fetch keeps the previous row.

    listing: (code, title, domain); details: (code, title, subject_areas, scope,
    publisher_name), a code without a row has failed; previous: the last catalogue.
    The audit's `complete` is false if a listed journal has neither.
    """
    wanted = listing.filter(~F.lower("code").isin(*skip)) if skip else listing
    old = previous.select(name_key("name").alias("key"), F.col("scope").alias("old_scope"), F.col("subject_areas").alias("old_areas"), F.col("publisher").alias("old_publisher"), "impact_factor").dropDuplicates(["key"])
    d = details.withColumnsRenamed({"title": "new_title"})
    both = wanted.join(d, "code", "left").withColumn("fetched", F.col("new_title").isNotNull()).withColumn("name", F.coalesce("new_title", "title")).withColumn("key", name_key("name")).join(old, "key", "left")
    state = F.when(F.col("fetched"), "fetched").when(F.col("old_scope").isNotNull(), "carried").otherwise("lost")
    rows = both.withColumn("state", state)
    made = rows.filter("state <> 'lost'").select("name", "code", F.array_compact(F.array(F.nullif("domain", F.lit("")))).alias("topics"), F.coalesce("subject_areas", "old_areas").alias("subject_areas"), F.coalesce("scope", "old_scope").alias("scope"), F.coalesce("publisher_name", "old_publisher").alias("publisher"), "impact_factor")
    audit = rows.agg(*[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("fetched", "carried", "lost")]).withColumn("complete", F.col("lost") == 0)
    return made, audit


def catalogue_stats(catalogue: DataFrame) -> DataFrame:
    """AG-33: (journals, scope_chars, areas_each, with_impact, thin)."""
    thin = (F.length("scope") < 200) & (F.size("subject_areas") < 3)
    return catalogue.agg(F.count("*").alias("journals"), F.sum(F.length("scope")).alias("scope_chars"), F.round(F.avg(F.size("subject_areas")), 6).alias("areas_each"), F.count("impact_factor").alias("with_impact"), F.count(F.when(thin, 1)).alias("thin"))
