"""A table of model responses by content, with lookups and resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def call_key(namespace: str, model: Column, system: Column, user: Column, params: Column) -> Column:
    """Hash of a call; ``params`` is a map of the arguments given, whose order doesn't matter."""
    ordered = F.to_json(F.array_sort(F.map_entries(params)))
    return F.sha2(F.to_json(F.struct(F.lit(namespace).alias("namespace"), model.alias("model"), system.alias("system"), user.alias("user"), ordered.alias("params"))), 256)


def lookup(calls: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls with their cached response, calls without one) by ``key``."""
    return calls.join(cache, "key"), calls.join(cache.select("key"), "key", "left_anti")


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0).cast("long")).alias("bytes"))


def clear(spark: SparkSession, path: str) -> int:
    """Empty the table at ``path``; returns how many entries it had."""
    table = spark.read.parquet(path)
    n, schema = table.count(), table.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return n


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys aren't among the results yet."""
    return work.join(done.select(*keys), keys, "left_anti")
