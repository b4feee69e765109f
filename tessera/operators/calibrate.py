"""Choice of a similarity threshold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import expressions as X
from tessera.functions.tables import materialize
from tessera.operators import align, diff, similarity

_COUNTS = ["v_miss", "v_halluc", "e_diff", "l_ged"]
#: The level of what holds at every threshold, and of what no threshold reaches.
_EVER, _NEVER = float("inf"), float("-inf")


def events(nodes: DataFrame, edges: DataFrame, backend: str = "tfidf", least: float = min(S.CALIBRATION_THRESHOLDS)) -> DataFrame:
    """How each pair's discrepancies change as the threshold falls: case_id, student, level, and what is added from that threshold down.

    The greedy assignment at a threshold is the one at a lower threshold cut there, as pairs are taken in order of similarity.
    So one assignment, at ``least``, tells them all: a match takes a missing and an extra node away at its similarity, an edge
    counts as soon as both its ends are matched. What holds without any match, and rules matched by citation, have the level infinity.
    """
    nodes = materialize(nodes)
    aligned = align.matched(nodes, *align.assigned(nodes, backend, least), backend)
    level = F.when(F.col("student_id").isNull(), _NEVER).when(F.col("method") == "citation", _EVER).otherwise(F.col("similarity"))
    aligned = materialize(aligned.select(*diff.KEY, "teacher_id", "student_id", level.alias("level")))

    def event(df: DataFrame, **changes: Column) -> DataFrame:
        zero = {c: F.lit(0.0 if c == "l_ged" else 0) for c in _COUNTS}
        return df.select(*diff.KEY, "level", *({**zero, **changes}[c].cast("double" if c == "l_ged" else "long").alias(c) for c in _COUNTS))

    parts, weight = [], F.col("weight")
    # a node id stands for all its rows: missing while one of them is, used once any match has it
    met = {"t": aligned.groupBy(*diff.KEY, F.col("teacher_id").alias("node_id")).agg(F.min("level").alias("level")), "s": aligned.where("student_id is not null").groupBy(*diff.KEY, F.col("student_id").alias("node_id")).agg(F.max("level").alias("level"))}
    for side, count in (("t", "v_miss"), ("s", "v_halluc")):
        own = nodes.where(F.col("side") == side).select(*diff.KEY, "node_id", "weight")
        parts.append(event(own.withColumn("level", F.lit(_EVER)), **{count: F.lit(1), "l_ged": weight}))
        parts.append(event(own.join(met[side], [*diff.KEY, "node_id"]).where(F.col("level") > _NEVER), **{count: F.lit(-1), "l_ged": -weight}))
    parts.append(_edge_events(nodes, aligned, edges, event))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return materialize(every.groupBy(*diff.KEY, "level").agg(*(F.sum(c).alias(c) for c in _COUNTS)))


def _edge_events(nodes: DataFrame, aligned: DataFrame, edges: DataFrame, event) -> DataFrame:
    """Differing edges come with the match of their second end. Where an id has several matches, the greatest partner so far is its own,
    so a partner holds from its level down to the level of a greater one."""
    end = Window.partitionBy(*diff.KEY, "teacher_id").orderBy(F.desc("level"))
    partners = aligned.where("student_id is not null").withColumn("student_id", F.max("student_id").over(end)).distinct().withColumn("until", F.coalesce(F.lead("level").over(end), F.lit(_NEVER)))
    weights = nodes.where("side = 't'").groupBy(*diff.KEY, F.col("node_id").alias("teacher_id")).agg(F.max_by("weight", F.struct(X.lookup(F.col("node_type"), S.LAYERS, 6), "pos")).alias("w"))
    maps = materialize(partners.join(weights, [*diff.KEY, "teacher_id"], "left"))
    t = edges.where("side = 't'")
    for own in ("src", "dst"):
        t = t.join(maps.select(*diff.KEY, F.col("teacher_id").alias(own), F.col("student_id").alias(f"student_{own}"), F.col("w").alias(f"w_{own}"), F.col("level").alias(f"from_{own}"), F.col("until").alias(f"until_{own}")), [*diff.KEY, own])
    have = edges.where("side = 's'").groupBy(*diff.KEY, F.col("src").alias("student_src"), F.col("dst").alias("student_dst")).agg(F.collect_set("type").alias("types"))
    out = t.join(have, [*diff.KEY, "student_src", "student_dst"], "left").where(F.col("types").isNull() | ~F.array_contains("types", F.col("type")))
    out = out.select(*diff.KEY, F.least("from_src", "from_dst").alias("level"), F.greatest("until_src", "until_dst").alias("until"), X.edge_weight(F.col("w_src"), F.col("w_dst")).alias("weight")).where("level > until")
    gone = out.where(F.col("until") > _NEVER).withColumn("level", F.col("until"))
    return event(out, e_diff=F.lit(1), l_ged=F.col("weight")).unionByName(event(gone, e_diff=F.lit(-1), l_ged=-F.col("weight")))


def calibration_curve(changes: DataFrame, digits: int = 9) -> DataFrame:
    """Counts and ``l_ged`` of every pair at every similarity at which they can change: threshold (rounded to ``digits``), case_id, student."""
    steps = changes.withColumn("threshold", F.round("level", digits)).groupBy(*diff.KEY, "threshold").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    so_far = Window.partitionBy(*diff.KEY).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("threshold", *diff.KEY, *(F.sum(c).over(so_far).alias(c) for c in _COUNTS)).where(F.col("threshold") < _EVER)


def threshold_scores(nodes: DataFrame, edges: DataFrame, thresholds: Sequence[float] = S.CALIBRATION_THRESHOLDS, backend: str = "tfidf") -> DataFrame:
    """Every pair of graphs aligned and scored at each threshold: threshold, case_id, student, counts and ``l_ged``.

    ``nodes`` has both sides and ``edges`` too, as alignment and discrepancies take them. Similarities and the assignment are worked
    out once, at the least threshold; each change goes to the highest threshold that it reaches, and a running sum over
    a pair's thresholds gives all of them.
    """
    levels = sorted({float(t) for t in thresholds})
    changes = events(nodes, edges, backend, levels[0])
    given = F.array(*map(F.lit, levels))
    reached = changes.withColumn("nth", F.size(F.filter(given, lambda x: x <= F.col("level")))).where("nth > 0")
    sums = reached.groupBy(*diff.KEY, "nth").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    grid = changes.select(*diff.KEY).distinct().withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(len(levels)))))
    so_far = Window.partitionBy(*diff.KEY).orderBy(F.desc("nth")).rowsBetween(Window.unboundedPreceding, 0)
    every = grid.join(sums, [*diff.KEY, "nth"], "left").na.fill(0, _COUNTS[:3]).na.fill(0.0, _COUNTS[3:])
    return every.select(*diff.KEY, F.element_at(given, F.col("nth")).alias("threshold"), *(F.sum(c).over(so_far).alias(c) for c in _COUNTS))


def judge(scores: DataFrame, better: str, worse: str, targets: Mapping[str, int] = S.CALIBRATION_TARGETS) -> DataFrame:
    """Per threshold, the criteria that ``scores`` (threshold, student, v_miss, v_halluc, l_ged) of one case meet."""

    def of(student: str, c: str):
        return F.max(F.when(F.col("student") == student, F.col(c)))

    out = scores.groupBy("threshold").agg(of(better, "v_miss").alias("v_miss"), of(better, "v_halluc").alias("v_halluc"), of(better, "l_ged").alias("l_ged_better"), of(worse, "l_ged").alias("l_ged_worse"))
    no = F.lit(False)
    out = out.withColumns(
        {
            "v_miss_ok": F.coalesce(F.col("v_miss").between(targets["v_miss_min"], targets["v_miss_max"]), no),
            "v_halluc_ok": F.coalesce(F.col("v_halluc") < targets["v_halluc_max"], no),
            "ranking_ok": F.coalesce(F.col("l_ged_better") < F.col("l_ged_worse"), no),
        }
    )
    return out.withColumn("all_ok", F.col("v_miss_ok") & F.col("v_halluc_ok") & F.col("ranking_ok"))


def recommend(judged: DataFrame) -> DataFrame:
    """The first threshold that meets all criteria, else the first of those that meet most in order of weight."""
    order = F.struct(~F.col("all_ok"), ~F.col("v_miss_ok"), ~F.col("v_halluc_ok"), ~F.col("ranking_ok"), F.col("threshold"))
    return judged.agg(F.min_by(F.struct(*judged.columns), order).alias("r")).select("r.*")


def match_counts(nodes: DataFrame, thresholds: Sequence[float] = S.CALIBRATION_THRESHOLDS) -> DataFrame:
    """Candidate pairs and nodes with any candidate at each threshold that has one, counted where texts meet."""
    levels = sorted({float(t) for t in thresholds})
    rows = similarity.tfidf_levels(nodes, levels)
    per_node = rows.groupBy(*similarity.NODE).agg(F.max("best").alias("best"), *(F.sum(F.get("pairs", F.lit(k))).alias(f"n{k}") for k in range(len(levels))))

    def of(k: int, side: str) -> Column:
        return F.count_if((F.col("side") == side) & (F.col("best") >= F.lit(levels[k])))

    counts = [F.struct(F.lit(x).alias("threshold"), F.sum(f"n{k}").alias("pairs"), of(k, "t").alias("teachers"), of(k, "s").alias("students")) for k, x in enumerate(levels)]
    return per_node.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*").where("pairs > 0")
