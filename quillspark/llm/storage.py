"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local master without one gets a folder of its temp folder, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or f"{tempfile.gettempdir()}/quillspark-checkpoints"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, so that lost executors cost no recomputation."""
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """materialise(), and the table's folder for a delete() before the scope's end."""
    path = new_folder(df.sparkSession, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names that no column has: underscores are put behind those that one does."""
    end = ""
    while {n + end for n in names} & set(columns):
        end += "_"
    return [n + end for n in names]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that materialise() writes inside, at its end; what is still to be read must be kept() before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        delete(spark, *_SCRATCH.pop())


def kept(df: DataFrame, name: str) -> DataFrame:
    """materialise() for the scope around the innermost scratch."""
    inner = _SCRATCH.pop()
    try:
        return materialise(df, name)
    finally:
        _SCRATCH.append(inner)


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes tables by the file system that they are in."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
