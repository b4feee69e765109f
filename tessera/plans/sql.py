"""DuckDB SQL for the derived graphs, as common table expressions that oracles are put together from."""

from __future__ import annotations

from tessera.plans.adapters import ORDERING

_ORD = ", ".join(ORDERING)

LINES = f"""
ln AS MATERIALIZED (
  SELECT li.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORD}) AS n,
         CASE WHEN l_linestatus = 'O' THEN row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY {_ORD}) END AS m,
         p_name, p_type, p_size, s_name, s_nationkey, n_name, o_orderpriority, o_orderstatus, o_orderdate
  FROM lineitem li LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
       LEFT JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey),
tl AS (SELECT *, n AS k, count(*) OVER (PARTITION BY l_orderkey) AS c FROM ln),
sl AS (SELECT *, m AS k, count(*) OVER (PARTITION BY l_orderkey) AS c FROM ln WHERE m IS NOT NULL)
"""

_AUTHORITY = "CASE s_nationkey % 4 WHEN 0 THEN 'binding' WHEN 1 THEN 'persuasive' WHEN 2 THEN 'advisory' ELSE 'overruled' END"
_DETERMINATION = "CASE o_orderstatus WHEN 'F' THEN 'compliant' WHEN 'O' THEN 'non-compliant' ELSE 'conditional' END"
REASONING = "CASE WHEN l_linestatus = 'O' THEN p_type || ' under ' || s_name ELSE '' END"
RESULT = "CASE l_returnflag WHEN 'A' THEN 'satisfied' WHEN 'R' THEN 'violated' ELSE 'partial' END"
CITATION = "'§ ' || (l_suppkey % 50) || '-' || p_size"


def nodes(src: str, name: str) -> str:
    """CTE ``name``: the nodes of graphs made from lines ``src`` (tl or sl)."""
    head = f"(SELECT DISTINCT l_orderkey, o_orderpriority, o_orderstatus FROM {src})"
    return f"""
{name} AS MATERIALIZED (
  SELECT l_orderkey::VARCHAR AS case_id, 'F' AS node_type, (k - 1)::INT AS pos, 'F' || k AS node_id, p_name AS label, p_name AS match_text,
         NULL::VARCHAR AS citation, NULL::VARCHAR AS authority, 1.0::DOUBLE AS weight FROM {src}
  UNION ALL SELECT l_orderkey::VARCHAR, 'I', 0, 'I1', o_orderpriority, o_orderpriority, NULL, NULL, 1.5 FROM {head}
  UNION ALL SELECT l_orderkey::VARCHAR, 'R', (k - 1)::INT, 'R' || k, s_name, s_name || ' ' || {CITATION}, {CITATION}, {_AUTHORITY},
         2.0 * CASE s_nationkey % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 ELSE 0.5 END FROM {src}
  UNION ALL SELECT l_orderkey::VARCHAR, 'A', (k - 1)::INT, 'A' || k, CASE WHEN {REASONING} = '' THEN '' ELSE {REASONING} END, {REASONING}, NULL, NULL, 2.5 FROM {src}
  UNION ALL SELECT l_orderkey::VARCHAR, 'C', 0, 'C1', {_DETERMINATION}, {_DETERMINATION} || ' ' || string_agg('A' || k, ' ' ORDER BY k), NULL, NULL, 1.5
         FROM {src} GROUP BY l_orderkey, o_orderstatus
  UNION ALL SELECT l_orderkey::VARCHAR, 'O', 0, 'O1', o_orderpriority || ' handling', o_orderpriority || ' handling R1', NULL, NULL, 2.5 FROM {head})
"""


def edges(src: str, name: str) -> str:
    """CTE ``name``: the edges of graphs made from lines ``src``."""
    uses = "'applies-to'" if src == "tl" else "CASE WHEN l_returnflag = 'R' THEN 'supports' ELSE 'applies-to' END"
    return f"""
{name} AS MATERIALIZED (
  SELECT l_orderkey::VARCHAR AS case_id, (3 * k - 3)::INT AS pos, 'E' || (3 * k - 2) AS eid, 'F' || k AS src, 'I1' AS dst, 'triggers' AS type,
         CASE WHEN l_returnflag = 'A' THEN 'returned' END AS justification FROM {src}
  UNION ALL SELECT l_orderkey::VARCHAR, (3 * k - 2)::INT, 'E' || (3 * k - 1), 'F' || k, 'A' || k, {uses}, NULL FROM {src}
  UNION ALL SELECT l_orderkey::VARCHAR, (3 * k - 1)::INT, 'E' || (3 * k), 'A' || k, 'C1', 'satisfies-element', NULL FROM {src}
  UNION ALL SELECT DISTINCT l_orderkey::VARCHAR, (3 * c)::INT, 'E' || (3 * c + 1), 'R1', 'O1', 'triggers', NULL FROM {src})
"""


GIVEN = """
op AS (SELECT DISTINCT l_orderkey, o_orderpriority FROM ln WHERE m IS NOT NULL),
al AS (
  SELECT l_orderkey::VARCHAR AS case_id, k AS node_type, k || 1 AS teacher_id, CASE WHEN o_orderpriority <> '5-LOW' THEN k || 1 END AS student_id
  FROM op, (SELECT unnest(['I', 'C', 'O']) AS k)
  UNION ALL
  SELECT l.l_orderkey::VARCHAR, k, k || n, CASE WHEN l.o_orderpriority <> '5-LOW' THEN k || m END
  FROM ln l JOIN op ON l.l_orderkey = op.l_orderkey, (SELECT unnest(['F', 'R', 'A']) AS k))
"""

TEXT_NODES = """
tn0 AS (SELECT source AS case_id, CASE WHEN (doc_id // 20) % 2 = 0 THEN 't' ELSE 's' END AS side, substr('FIRACO', ((doc_id // 40) % 6)::INT + 1, 1) AS node_type,
               doc_id AS ident, coalesce(text, '') AS match_text FROM documents),
nd AS (SELECT *, row_number() OVER (PARTITION BY case_id, node_type, side ORDER BY ident) AS pos, node_type || ident AS node_id,
              CASE node_type WHEN 'F' THEN 1.0 WHEN 'I' THEN 1.5 WHEN 'R' THEN 4.0 WHEN 'A' THEN 2.5 WHEN 'C' THEN 1.5 ELSE 2.5 END AS weight FROM tn0)
"""

RULE_NODES = """
rn0 AS (SELECT p_brand AS case_id, 't' AS side, p_partkey AS ident, p_name, '§ ' || (p_partkey % 7) || '-' || p_size AS citation FROM part
        UNION ALL SELECT p_brand, 's', p_partkey, p_name, 'Section ' || (p_partkey % 5) || '-' || p_size FROM part),
nd AS (SELECT *, 'R' AS node_type, row_number() OVER (PARTITION BY case_id, side ORDER BY ident) AS pos, 'R' || ident AS node_id, p_name || ' ' || citation AS match_text, 4.0 AS weight FROM rn0),
tk AS (SELECT DISTINCT case_id, side, pos, lower(regexp_replace(unnest(regexp_extract_all(citation, '(?i)(?:§|sec(?:tion|\\.)?)[\\s\\x{00A0}]*([0-9A-Za-z][\\p{L}\\p{N}_\\-.()]*)', 1)), '[.,;:]+$', '')) AS token FROM nd)
"""


def tfidf(src: str, threshold: float, out: str = "pr") -> str:
    """CTE ``out`` (case_id, node_type, t_pos, s_pos, sim) over nodes ``src``."""
    return f"""
w AS (SELECT case_id, node_type, side, pos, regexp_extract_all(lower(match_text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {src}),
gn AS (SELECT case_id, node_type, count(*) AS n FROM {src} GROUP BY ALL),
tm AS (SELECT case_id, node_type, side, pos, unnest(w) AS term FROM w
       UNION ALL SELECT case_id, node_type, side, pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
tf AS (SELECT case_id, node_type, side, pos, term, count(*) AS tf FROM tm GROUP BY ALL),
tw AS (SELECT tf.*, tf * (ln((1.0 + n) / (1.0 + count(*) OVER (PARTITION BY tf.case_id, tf.node_type, term))) + 1.0) AS w
       FROM tf JOIN gn ON tf.case_id = gn.case_id AND tf.node_type = gn.node_type),
nm AS (SELECT case_id, node_type, side, pos, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL),
dt AS (SELECT a.case_id, a.node_type, a.pos AS t_pos, b.pos AS s_pos, sum(a.w * b.w) AS dot FROM tw a
       JOIN tw b ON a.case_id = b.case_id AND a.node_type = b.node_type AND a.term = b.term AND a.side = 't' AND b.side = 's' GROUP BY ALL),
{out} AS (SELECT dt.case_id, dt.node_type, t_pos, s_pos, round(dot / (x.norm * y.norm), 12) AS sim FROM dt
       JOIN nm x ON x.case_id = dt.case_id AND x.node_type = dt.node_type AND x.side = 't' AND x.pos = t_pos
       JOIN nm y ON y.case_id = dt.case_id AND y.node_type = dt.node_type AND y.side = 's' AND y.pos = s_pos
       WHERE round(dot / (x.norm * y.norm), 12) >= {threshold})
"""


def greedy(src: str, out: str) -> str:
    """Recursive CTE ``out`` (case_id, node_type, t_pos, s_pos, sim, ok): the greedy walk over pairs ``src``."""
    return f"""
rk_{out} AS (SELECT case_id, node_type, t_pos::BIGINT AS t_pos, s_pos::BIGINT AS s_pos, sim, row_number() OVER (PARTITION BY case_id, node_type ORDER BY sim DESC, t_pos, s_pos) AS rn FROM {src}),
{out} AS (
  SELECT case_id, node_type, rn, [t_pos] AS ut, [s_pos] AS us, t_pos, s_pos, sim, true AS ok FROM rk_{out} WHERE rn = 1
  UNION ALL
  SELECT r.case_id, r.node_type, r.rn,
         CASE WHEN list_contains(ut, r.t_pos) OR list_contains(us, r.s_pos) THEN ut ELSE list_append(ut, r.t_pos) END,
         CASE WHEN list_contains(ut, r.t_pos) OR list_contains(us, r.s_pos) THEN us ELSE list_append(us, r.s_pos) END,
         r.t_pos, r.s_pos, r.sim, NOT (list_contains(ut, r.t_pos) OR list_contains(us, r.s_pos))
  FROM {out} p JOIN rk_{out} r ON p.case_id = r.case_id AND p.node_type = r.node_type AND r.rn = p.rn + 1)
"""


VECTOR_NODES = """
vn AS (SELECT label::VARCHAR AS case_id, 'F' AS node_type, CASE WHEN vec_id % 2 = 0 THEN 't' ELSE 's' END AS side, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL),
nd AS (SELECT *, row_number() OVER (PARTITION BY case_id, side ORDER BY vec_id) AS pos, 'F' || vec_id AS node_id, 1.0 AS weight FROM vn)
"""


def vector_pairs(threshold: float) -> str:
    return f"""
pr AS (SELECT a.case_id, a.node_type, a.pos AS t_pos, b.pos AS s_pos, round(list_cosine_similarity(a.v, b.v), 12) AS sim
       FROM nd a JOIN nd b ON a.case_id = b.case_id AND a.side = 't' AND b.side = 's' WHERE round(list_cosine_similarity(a.v, b.v), 12) >= {threshold})
"""
