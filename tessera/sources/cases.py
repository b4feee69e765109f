"""Case documents and statutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expressions as X

_STRIP = r"^\s+|\s+$"
_QUOTES = r"^`+|`+$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _STRIP, "")


def _bare(c: Column) -> Column:
    """Without space, then backticks, then quotes around it."""
    return F.regexp_replace(F.regexp_replace(_trim(c), _QUOTES, ""), r'^"+|"+$', "")


def _read(spark: SparkSession, path: str, glob: str) -> DataFrame:
    df = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(X.file_name().alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("raw"))


def sections(raw: Column) -> Column:
    """Map of section heads to bodies; of equal heads the last counts, text before the first is left out."""
    parts = F.transform(F.slice(F.split(raw, r"(?m)^## "), F.lit(2), F.lit(1 << 20)), lambda s: F.struct(_trim(F.substring_index(s, "\n", 1)), _trim(F.when(s.contains("\n"), F.substring(s, F.instr(s, "\n") + 1, F.length(s))).otherwise(""))))
    last = F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, i + 2, F.greatest(F.size(parts) - i - 1, F.lit(0))), lambda q: q["col1"] == p["col1"]))
    return F.map_from_entries(last)


def scalar(meta: Column, key: str) -> Column:
    """Value of the first line that holds ``key`` anywhere, empty without one."""
    line = F.filter(F.split(F.coalesce(meta, F.lit("")), "\n"), lambda x: F.lower(x).contains(key))
    first = F.get(line, F.lit(0))
    return F.coalesce(_bare(F.when(first.contains(":"), F.substring(first, F.instr(first, ":") + 1, F.length(first)))), F.lit(""))


def listing(meta: Column, key: str) -> Column:
    parts = F.transform(F.split(F.translate(scalar(meta, key), "+", ","), ","), _trim)
    return F.filter(parts, lambda x: x != "")


def strict(meta: Column, key: str) -> Column:
    """Value of the last line whose key is exactly ``key``, dashes before it aside."""
    lines = F.filter(F.split(F.coalesce(meta, F.lit("")), "\n"), lambda x: x.contains(":") & (F.lower(_trim(F.regexp_replace(_trim(F.substring_index(x, ":", 1)), "^-+", ""))) == key))
    last = F.get(F.reverse(lines), F.lit(0))
    return F.coalesce(_bare(F.substring(last, F.instr(last, ":") + 1, F.length(last))), F.lit(""))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from Markdown files named by their id, sorted by it."""
    docs = _read(spark, path, "*.md").withColumn("s", sections(F.col("raw")))
    meta = F.col("s")["Metadata"]
    empty = F.lit("")
    return docs.select(
        F.substring_index("file", "_", 1).alias("case_id"),
        _trim(F.regexp_extract("raw", r"(?m)^# (.*)$", 1)).alias("title"),
        F.coalesce(F.col("s")["Facts"], empty).alias("facts"),
        F.coalesce(F.col("s")["Question"], empty).alias("question"),
        listing(meta, "jurisdiction").alias("jurisdiction_tags"),
        scalar(meta, "doctrinal_area").alias("doctrinal_area"),
        scalar(meta, "tier").alias("tier"),
        scalar(meta, "role").alias("role"),
    ).orderBy("case_id")


def read_case_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Tier and role by the stricter reading of the metadata section, whose head may be in any case."""
    docs = _read(spark, path, "*.md").withColumn("s", sections(F.col("raw")))
    meta = F.element_at(F.map_values(F.map_filter("s", lambda k, v: F.lower(k) == "metadata")), -1)
    meta = F.when(F.exists(F.map_keys("s"), lambda k: F.lower(k) == "metadata"), meta)
    return docs.select(F.substring_index("file", "_", 1).alias("case_id"), strict(meta, "tier").alias("tier"), strict(meta, "role").alias("role"))


def read_statutes(spark: SparkSession, path: str) -> DataFrame:
    """All statute texts in one, each under a line with its name. Statutes are a handful of files."""
    docs = _read(spark, path, "*.txt").withColumn("stem", F.regexp_replace("file", r"\.txt$", ""))
    part = F.struct("stem", F.concat(F.lit("--- "), "stem", F.lit(" ---\n"), "raw").alias("t"))
    return docs.agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("statutes"))
