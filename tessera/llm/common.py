"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.tables import materialize, shared_dir, ship, small_batches

__all__ = ["WS", "WS_RE", "attempt_name", "let", "materialize", "open_fs", "read", "shared_dir", "shipped", "spread", "words_of"]

#: White space between words, as a set for trimming and as a regular expression.
WS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"


def open_fs(uri: str):
    """A file system and path for ``uri`` on an executor (local paths, and any store pyarrow knows)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once the workers have this package and get their rows in small batches."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RE))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out evenly where its files come in fewer parts than there are cores to read them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def attempt_name() -> tuple[int, str]:
    """This task's partition, and a suffix for files that only this attempt writes."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.partitionId(), f".{task.taskAttemptId()}.tmp"
