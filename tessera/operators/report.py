"""Result tables over scored pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import expressions as X

METRICS = ("teacher_nodes", "student_nodes", "v_miss", "v_halluc", "e_diff", "l_ged")
COUNTS = ("teacher_nodes", "student_nodes", "f", "i", "r", "a", "c", "o")


def results_table(scores: DataFrame, cases: DataFrame, counts: DataFrame) -> DataFrame:
    """Scores with case metadata and node counts; what is missing is empty or 0, never null."""
    out = scores.join(cases.select("case_id", "tier", "role"), "case_id", "left").join(counts.select("case_id", "student", *COUNTS), ["case_id", "student"], "left")
    out = out.na.fill("", ["tier", "role"]).na.fill(0, list(COUNTS))
    return out.select("case_id", "tier", "role", "student", *COUNTS, "v_miss", "v_halluc", "e_diff", "l_ged")


def graph_counts(teacher: DataFrame, student: DataFrame) -> DataFrame:
    """Node counts of student graphs, with the teacher graph's total (0 without one)."""
    t = teacher.groupBy("case_id").agg(F.max("total").alias("teacher_nodes"))
    s = student.select("case_id", X.student_of(F.col("agent_id")).alias("student"), F.col("total").alias("student_nodes"), "f", "i", "r", "a", "c", "o")
    return s.join(t, "case_id", "left").na.fill(0, ["teacher_nodes"])


def node_type_table(results: DataFrame) -> DataFrame:
    names = {"f": "F", "i": "I", "r": "R", "a": "A", "c": "C", "o": "O"}
    return results.select(F.col("case_id").alias("Case"), F.col("student").alias("Student"), *(F.col(k).alias(v) for k, v in names.items()), F.col("student_nodes").alias("Total"))


def tier_summary(results: DataFrame) -> DataFrame:
    """Per tier and student (nulls are groups too): cases and means, rounded to 2 places with halves to even."""
    means = [X.half_even(F.avg(F.col(m).cast("double")), 2).alias(m) for m in METRICS]
    return results.groupBy("tier", "student").agg(F.countDistinct("case_id").alias("cases"), *means)


def report_order(results: DataFrame) -> DataFrame:
    """With ``tier_order``, sorted by it, case and student."""
    return results.withColumn("tier_order", X.tier_order(F.coalesce("tier", F.lit("")))).orderBy("tier_order", "case_id", "student")


def melt_counts(results: DataFrame) -> DataFrame:
    """Nodes per graph in long form: the teacher once a case (that of its first student), then every student."""
    first = results.groupBy("case_id").agg(F.min_by("teacher_nodes", "student").alias("nodes")).select("case_id", F.lit("teacher").alias("graph"), "nodes")
    long = results.select("case_id", "student", "student_nodes").unpivot(["case_id", "student"], ["student_nodes"], "what", "nodes")
    return first.unionByName(long.select("case_id", F.col("student").alias("graph"), "nodes"))


def merge_methods(tfidf: DataFrame, embedding: DataFrame) -> DataFrame:
    """Both methods' summaries side by side; pairs that only one has are left out."""
    key = ["case_id", "student", "tier"]
    cols = ("v_miss", "v_halluc", "e_diff", "l_ged")
    a = tfidf.select(*key, *(F.col(c).alias(f"{c}_tfidf") for c in cols))
    b = embedding.select(*key, *(F.col(c).alias(f"{c}_embedding") for c in cols))
    return a.join(b, key)


def ranking(summary: DataFrame, students: Sequence[str]) -> DataFrame:
    """Scores of two students per case, and whether the first scores lower; false where one is missing."""
    a, b = students
    wide = summary.groupBy("case_id", "tier").pivot("student", list(students)).agg(F.avg("l_ged"))
    return wide.withColumn("correct", F.coalesce(F.col(f"`{a}`") < F.col(f"`{b}`"), F.lit(False)))


def compare_rankings(tfidf: DataFrame, embedding: DataFrame, students: Sequence[str]) -> DataFrame:
    """Rankings by both methods for the cases that both have."""
    a = ranking(tfidf, students).select("case_id", "tier", F.col("correct").alias("correct_tfidf"))
    b = ranking(embedding, students).select("case_id", "tier", F.col("correct").alias("correct_embedding"))
    return a.join(b, ["case_id", "tier"])


def correct_rankings(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("cases"), F.count_if("correct_tfidf").alias("tfidf"), F.count_if("correct_embedding").alias("embedding"))


def method_series(tfidf: DataFrame, embedding: DataFrame, students: Sequence[str]) -> DataFrame:
    """Per case one column for each method and student."""
    both = tfidf.select("case_id", "student", "l_ged", F.lit("TF-IDF").alias("method")).unionByName(embedding.select("case_id", "student", "l_ged", F.lit("Embedding").alias("method")))
    names = [f"{m} — {s}" for m in ("TF-IDF", "Embedding") for s in students]
    return both.withColumn("series", F.concat_ws(" — ", "method", "student")).groupBy("case_id").pivot("series", names).agg(F.avg("l_ged"))


def node_deltas(counts: DataFrame) -> DataFrame:
    """Teacher less student, in nodes and obligations, from counts with both sides' columns."""
    return counts.select("case_id", "student", (F.col("teacher_nodes") - F.col("student_nodes")).alias("node_delta"), (F.col("teacher_o") - F.col("o")).alias("obligation_delta"))


def render_html(results: DataFrame, title: str = "Results") -> str:
    """A self-contained page with the results, node types and tiers. The tables have a row a pair: small by nature."""
    from html import escape

    def table(df: DataFrame, name: str) -> str:
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.collect())
        return f'<h2>{escape(name)}</h2><table id="{escape(name.lower().replace(" ", "-"))}"><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>'

    parts = [table(report_order(results).drop("tier_order"), "Results"), table(node_type_table(results).orderBy("Case", "Student"), "Node types"), table(report_order(tier_summary(results).withColumn("case_id", F.lit(""))).drop("tier_order", "case_id"), "Tiers")]
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{''.join(parts)}</body></html>"
