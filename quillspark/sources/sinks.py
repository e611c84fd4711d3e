"""Sinks: idempotent daily records, findings, retention, stream upserts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local master without one gets a folder of its temp folder, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or f"{tempfile.gettempdir()}/quillspark-checkpoints"


def written(df: DataFrame, name: str, compression: str | None = None, plain: bool = False) -> DataFrame:
    """df, written as a Parquet table of the shared folder and read again.

    plain: neither compressed nor with dictionaries.  A join broadcasts what its files
    make look small, and texts that repeat take a hundredth of their size there.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    options = {"compression": "none", "parquet.enable.dictionary": "false"} if plain else {"compression": compression} if compression else {}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_daily(df: DataFrame, path: str, date: str = "date") -> None:
    """SNK-1: one record for each date; running a day again replaces its partition and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """SNK-2: findings by family, with paragraphs counted from 1 for readers; a document-level finding keeps a null place."""
    findings.withColumn("paragraph", F.col("idx") + 1).drop("idx").write.mode("overwrite").partitionBy("family").parquet(path)


def retain(df: DataFrame, column: str, days: int, now) -> DataFrame:
    """SNK-3: rows younger than `days` before `now`; 0 days keeps all."""
    return df if days == 0 else df.filter(F.col(column) > F.lit(now) - F.make_dt_interval(F.lit(days)))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SO-5: old rows without a successor of their key, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_stream(path: str, key: str, order: str, buckets: int = 64):
    """SNK-4: a foreachBatch function that keeps the latest row (by `order`) of each key.

    Keys are dealt to `buckets` partitions.  A batch merges the partitions that it
    touches with its own rows beside the table, then replaces them; one that runs
    again writes the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        old = spark.read.schema(new.schema).option("ignoreMissingFiles", "true").parquet(path).filter(F.col("bucket").isin(touched)) if _exists(spark, path) else new.filter("false")
        fields = [c for c in batch.columns if c != key]
        latest = new.unionByName(old).groupBy("bucket", key).agg(F.max_by(F.struct(*fields), F.struct(order, F.xxhash64(*batch.columns))).alias("row")).select(key, "row.*", "bucket")
        beside = f"{path}-merge-{batch_id}"
        latest.write.mode("overwrite").parquet(beside)
        spark.read.schema(latest.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return write


def batch_folders(path: str):
    """A foreachBatch function that writes each batch to a folder of its own, and anew if it runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_daily(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
