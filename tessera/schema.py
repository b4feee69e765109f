"""The data model: graph schema, closed value sets, identifier patterns and weights."""

from __future__ import annotations

# Names, sets, patterns and weights that results depend on.
GRAPH_DDL = """
case_id STRING, source STRING, model_name STRING, agent_id STRING,
facts ARRAY<STRUCT<fid: STRING, label: STRING, polarity: STRING, support_quote: STRING>>,
issues ARRAY<STRUCT<iid: STRING, label: STRING, status: STRING>>,
rules ARRAY<STRUCT<rid: STRING, citation: STRING, label: STRING, authority: STRING, jurisdiction: STRING, effective_as_of: STRING>>,
applications ARRAY<STRUCT<aid: STRING, rule_ref: STRING, fact_refs: ARRAY<STRING>, issue_ref: STRING, result: STRING, reasoning: STRING>>,
conclusions ARRAY<STRUCT<cid: STRING, determination: STRING, confidence: STRING, support_refs: ARRAY<STRING>>>,
obligations ARRAY<STRUCT<oid: STRING, label: STRING, required_by: STRING, status: STRING, jurisdiction: STRING, deadline: STRING>>,
edges ARRAY<STRUCT<eid: STRING, src: STRING, dst: STRING, type: STRING, justification: STRING>>
"""
DISCREPANCY_DDL = """
case_id STRING, student_id STRING,
v_miss ARRAY<STRUCT<teacher_id: STRING, node_type: STRING, label: STRING, weight: DOUBLE>>,
v_halluc ARRAY<STRUCT<student_id: STRING, node_type: STRING, label: STRING, reason: STRING, weight: DOUBLE>>,
e_diff ARRAY<STRUCT<teacher_eid: STRING, teacher_src: STRING, teacher_dst: STRING, teacher_type: STRING,
                    student_src: STRING, student_dst: STRING, student_type: STRING, kind: STRING, weight: DOUBLE>>,
l_ged DOUBLE, node_type_breakdown MAP<STRING, STRUCT<v_miss: BIGINT, v_halluc: BIGINT>>
"""
SUMMARY_DDL = "case_id STRING, student STRING, v_miss_count BIGINT, v_halluc_count BIGINT, e_diff_count BIGINT, l_ged_score DOUBLE"
SWEEP_DDL = "case_id STRING, student STRING, teacher_nodes BIGINT, student_nodes BIGINT, v_miss_count BIGINT, v_halluc_count BIGINT, e_diff_count BIGINT, l_ged_score DOUBLE"

NODE_TYPES = ("F", "I", "R", "A", "C", "O")
#: node type -> (list column, id field)
NODE_LISTS = {
    "F": ("facts", "fid"),
    "I": ("issues", "iid"),
    "R": ("rules", "rid"),
    "A": ("applications", "aid"),
    "C": ("conclusions", "cid"),
    "O": ("obligations", "oid"),
}
ENUMS = {
    "polarity": ("present", "disputed", "absent", "unknown"),
    "issue_status": ("dispositive", "collateral", "waived"),
    "authority": ("binding", "persuasive", "advisory", "overruled"),
    "result": ("satisfied", "violated", "requires-fact", "partial"),
    "determination": ("compliant", "non-compliant", "conditional"),
    "confidence": ("high", "medium", "low"),
    "obligation_status": ("mandatory", "recommended", "safe-harbor"),
    "edge_type": ("supports", "contradicts", "applies-to", "triggers", "satisfies-element", "fails-element", "preempts", "distinguishes"),
    "source": ("agent", "reference"),
}
NODE_WEIGHTS = {"F": 1.0, "I": 1.5, "R": 2.0, "A": 2.5, "C": 1.5, "O": 2.5}
AUTHORITY_WEIGHTS = {"binding": 2.0, "persuasive": 1.0, "advisory": 0.75, "overruled": 0.5}
TIER_OF_PREFIX = {"E": "easy", "M": "medium", "H": "hard"}
TIER_ORDER = {"easy": 0, "medium": 1, "hard": 2, "": 3}
LAYERS = {"F": 0, "I": 1, "R": 2, "A": 3, "C": 4, "O": 5}
TFIDF_THRESHOLD, EMBEDDING_THRESHOLD = 0.10, 0.55
JSON_MARKER = "=== JSON GRAPH ==="
CALIBRATION_THRESHOLDS = (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40)
CALIBRATION_TARGETS = {"v_miss_min": 18, "v_miss_max": 22, "v_halluc_max": 10}
#: The fields of a graph, in order.
GRAPH_FIELDS = ("case_id", "source", "model_name", "agent_id", *(column for column, _ in NODE_LISTS.values()), "edges")
