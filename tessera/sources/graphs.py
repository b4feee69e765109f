"""Readers and writers of graphs, discrepancy reports, summaries and raw responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera import schema as S
from tessera.functions import expressions as X
from tessera.operators.nodes import node_counts


def _stem() -> Column:
    return F.regexp_replace(X.file_name(), r"\.[^.]*$", "")


def _json(spark: SparkSession, path: str, ddl: str, glob: str) -> DataFrame:
    reader = spark.read.schema(ddl + ", _broken STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", glob)
    return reader.json(path)


def read_graphs(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Graphs from files of one object each, with ``file`` and ``broken``; a file that isn't JSON has broken true."""
    df = _json(spark, path, S.GRAPH_DDL, glob)
    return df.withColumn("file", _stem()).withColumn("broken", F.col("_broken").isNotNull()).drop("_broken")


def write_graphs(graphs: DataFrame, path: str, form: str = "parquet") -> None:
    """Partitioned by case and source, so that a selection of either reads its folders only."""
    graphs.write.mode("overwrite").partitionBy("case_id", "source").format(form).save(path)


def graph_name(case_id: Column, source: Column, agent_id: Column) -> Column:
    """Canonical file name of a graph."""
    agent = F.when(agent_id.isNull(), F.concat(case_id, F.lit("_agent.json"))).otherwise(F.concat(case_id, F.lit("_agent_"), agent_id, F.lit(".json")))
    return F.when(source == "reference", F.concat(case_id, F.lit("_reference.json"))).otherwise(agent)


def response_name(case_id: Column, source: Column, agent_id: Column) -> Column:
    label = F.when(source == "reference", "reference").otherwise(F.concat(F.lit("agent_"), F.coalesce(agent_id, F.lit("unknown"))))
    return F.concat(case_id, F.lit("_"), label, F.lit("_raw.txt"))


def read_discrepancies(spark: SparkSession, path: str) -> DataFrame:
    """Discrepancy reports; malformed files are left out, ids that are missing come from the file's name."""
    df = _json(spark, path, S.DISCREPANCY_DDL, "*.json").withColumn("file", _stem()).where("_broken is null").drop("_broken")
    parts = F.split(F.col("file"), "_", 2)
    rest = F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    known = X.filled(F.col("case_id"))
    return df.withColumn("student_id", F.when(known.isNull(), rest).otherwise(F.coalesce(X.filled(F.col("student_id")), rest))).withColumn("case_id", F.coalesce(known, parts[0]))


def score_reports(reports: DataFrame) -> DataFrame:
    """Counts and score per report, as they stand, with the score that the listed weights add up to."""

    def n(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")

    def weights(c: str) -> Column:
        return F.aggregate(F.coalesce(F.transform(c, lambda x: x["weight"]), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)

    return reports.select(
        "case_id", F.col("student_id").alias("student"), *(n(c).alias(c) for c in ("v_miss", "v_halluc", "e_diff")), F.coalesce("l_ged", F.lit(0.0)).alias("l_ged"),
        (weights("v_miss") + weights("v_halluc") + weights("e_diff")).alias("weight_sum"),
    )


def read_graph_counts(spark: SparkSession, path: str) -> DataFrame:
    """Node counts of student graphs with their teacher's; ids fall back to the file's name."""
    from tessera.operators.report import graph_counts

    t = read_graphs(spark, path, "*_reference.json").where("not broken").withColumn("case_id", F.coalesce("case_id", "file"))
    s = read_graphs(spark, path, "*_agent_*.json").where("not broken")
    cut = F.split(F.col("file"), "_agent_")
    s = s.withColumn("case_id", F.coalesce(X.filled(F.col("case_id")), cut[0])).withColumn("agent_id", F.coalesce(X.filled(F.col("agent_id")), F.element_at(cut, -1)))
    return graph_counts(node_counts(t), node_counts(s))


def read_summary(spark: SparkSession, path: str, sweep: bool = False) -> DataFrame | None:
    """A summary CSV with ``tier`` from the case id; None if the file isn't there."""
    try:
        df = spark.read.schema(S.SWEEP_DDL if sweep else S.SUMMARY_DDL).option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return df.withColumn("tier", X.tier_of_case(F.col("case_id")))


def write_summary(scores: DataFrame, path: str) -> None:
    """One CSV file; a summary has one row per pair."""
    sweep = [c for c in ("teacher_nodes", "student_nodes") if c in scores.columns]
    rows = scores.select("case_id", "student", *sweep, *(F.col(c).alias(f"{c}_count") for c in ("v_miss", "v_halluc", "e_diff")), F.round("l_ged", 4).alias("l_ged_score"))
    rows.orderBy("case_id", "student").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Raw responses, a file each, with ids from the file's name."""
    df = spark.read.option("pathGlobFilter", "*_raw.txt").text(path, wholetext=True).withColumn("file", _stem())
    name = r"^(.*?)_(reference|agent_(.*))_raw$"
    return df.select(
        F.regexp_extract("file", name, 1).alias("case_id"),
        F.when(F.regexp_extract("file", name, 2) == "reference", "reference").otherwise("agent").alias("source"),
        X.filled(F.regexp_extract("file", name, 3)).alias("agent_id"),
        F.col("value").alias("text"),
    )


def write_responses(responses: DataFrame, path: str) -> None:
    """As a table by case; one row keeps a response whole whatever line ends it holds."""
    responses.write.mode("overwrite").partitionBy("case_id").parquet(path)


def list_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Files of a folder, sorted; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime").orderBy("path")


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "template")
