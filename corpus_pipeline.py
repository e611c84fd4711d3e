"""The document pipeline: quality rules, line dedup, near-dedup, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, line_dedup, mixing, rules, simhash
from quillspark.llm.storage import materialise

STAGES = [
    ("quality_rules", rules.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: zstandard ratios, 64-bit shingle votes and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir; each result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
