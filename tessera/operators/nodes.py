"""Graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import expressions as X
from tessera.functions.tables import large

KEYS = ("case_id", "source", "agent_id")


def _node(kind: str, x: Column, pos: Column, raw: bool) -> Column:
    """One node of any type as a common struct; ``raw`` adds the whole node as JSON."""
    none = F.lit(None).cast("string")
    _, key = S.NODE_LISTS[kind]
    label = x["label"] if kind in "FIRO" else none
    reasoning = x["reasoning"] if kind == "A" else none
    determination = x["determination"] if kind == "C" else none
    citation = x["citation"] if kind == "R" else none
    e = F.lit("")
    text = {
        "F": label,
        "I": label,
        "R": F.concat(F.coalesce(label, e), F.lit(" "), F.coalesce(citation, e)),
        "A": reasoning,
        "C": F.concat(F.coalesce(determination, e), F.lit(" "), F.coalesce(F.array_join(x["support_refs"], " "), e)) if kind == "C" else none,
        "O": F.concat(F.coalesce(label, e), F.lit(" "), F.coalesce(x["required_by"], e)) if kind == "O" else none,
    }[kind]
    authority = x["authority"] if kind == "R" else none
    return F.struct(
        F.lit(kind).alias("node_type"),
        pos.cast("int").alias("pos"),
        x[key].alias("node_id"),
        X.label_of(label, reasoning, determination, citation).alias("label"),
        text.alias("match_text"),
        citation.alias("citation"),
        authority.alias("authority"),
        X.node_weight(F.lit(kind), authority).alias("weight"),
        *([F.to_json(x).alias("raw")] if raw else []),
    )


def flatten_nodes(graphs: DataFrame, raw: bool = False) -> DataFrame:
    """One row per node, types in the order F, I, R, A, C, O; a missing list is an empty one. With ``raw``, each node's
    JSON too, which costs as much as all else and can't be pruned from a list that is exploded.

    The lists are joined before one explode, so a graph is read once and only the columns asked for later
    are read at all.
    """
    return graphs.select(*KEYS, F.explode(node_list(raw)).alias("n")).select(*KEYS, "n.*")


def node_list(raw: bool = False) -> Column:
    """All nodes of a graph as one array."""
    return F.concat(*(F.coalesce(_typed(kind, column, raw), F.array()) for kind, (column, _) in S.NODE_LISTS.items()))


def _typed(kind: str, column: str, raw: bool) -> Column:
    return F.transform(F.col(column), lambda x, i: _node(kind, x, i, raw))


def labelled_ids() -> Column:
    """All nodes of a graph as (id, label), in list order, inside its row."""

    def of(kind: str) -> Column:
        column, key = S.NODE_LISTS[kind]
        have = {"F": ("label",), "I": ("label",), "R": ("label", "citation"), "A": ("reasoning",), "C": ("determination",), "O": ("label",)}[kind]

        def one(x: Column) -> Column:
            parts = (x[f] if f in have else F.lit(None).cast("string") for f in ("label", "reasoning", "determination", "citation"))
            return F.struct(x[key].alias("id"), X.label_of(*parts).alias("label"))

        return F.coalesce(F.transform(F.col(column), one), F.array())

    return F.concat(*map(of, S.NODE_LISTS))


def flatten_edges(graphs: DataFrame) -> DataFrame:
    return graphs.select(*KEYS, F.posexplode("edges").alias("pos", "e")).select(*KEYS, "pos", "e.*")


def node_counts(graphs: DataFrame, *more: str) -> DataFrame:
    """Nodes per type, edges, total of nodes, and a one-line summary; ``more`` is what else of a row goes along."""
    size = {k: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(F.col(c))).cast("long") for k, (c, _) in S.NODE_LISTS.items()}
    edges = F.when(F.col("edges").isNull(), F.lit(0)).otherwise(F.size("edges")).cast("long")
    out = graphs.select(*KEYS, *more, *(v.alias(k.lower()) for k, v in size.items()), edges.alias("e"))
    total = sum((F.col(k.lower()) for k in S.NODE_TYPES[1:]), F.col("f"))
    parts = [x for k in (*S.NODE_TYPES, "E") for x in (F.lit(f"{k}="), F.col(k.lower()).cast("string"), F.lit(" "))][:-1]
    return out.withColumn("total", total).withColumn("summary", F.concat(*parts))


def index_nodes(nodes: DataFrame, *more: str) -> DataFrame:
    """One row per id of a graph (``more`` may tell graphs apart besides their keys): of duplicates the last in list order stays."""
    w = Window.partitionBy(*KEYS, *more, "node_id").orderBy(X.lookup(F.col("node_type"), S.LAYERS, 6).desc(), F.col("pos").desc())
    return nodes.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def edges_with_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the larger weight of their ends."""
    ends = index_nodes(nodes).select(*KEYS, "node_id", "weight")
    src = ends.withColumnsRenamed({"node_id": "src", "weight": "w_src"})
    dst = ends.withColumnsRenamed({"node_id": "dst", "weight": "w_dst"})
    keys = [*KEYS]
    return _left(_left(edges, src, [*keys, "src"]), dst, [*keys, "dst"]).withColumn("weight", X.edge_weight(F.col("w_src"), F.col("w_dst"))).drop("w_src", "w_dst")


def weighted_edges(graphs: DataFrame) -> DataFrame:
    """:func:`edges_with_weights` of graphs that are a row each, from that row: of nodes that share an id the last counts."""
    last_first = F.reverse(F.transform(node_list(), lambda n: F.struct(n["node_id"].alias("id"), n["weight"].alias("w"))))
    rows = graphs.select(*KEYS, "edges", F.explode(F.array(last_first)).alias("n"))
    rows = rows.select(*KEYS, F.transform("n", lambda n: n["id"]).alias("ids"), F.transform("n", lambda n: n["w"]).alias("ws"), F.posexplode("edges").alias("pos", "e"))
    w_src, w_dst = (F.get("ws", (F.array_position("ids", F.col(f"e.{end}")) - 1).cast("int")) for end in ("src", "dst"))
    return rows.select(*KEYS, "pos", "e.*", X.edge_weight(w_src, w_dst).alias("weight"))


def _left(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys of which agent_id may be null on both sides."""
    right = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) if k == "agent_id" else F.col(k) == F.col(f"_{k}") for k in keys]
    return a.join(large(right), on, "left").drop(*(f"_{k}" for k in keys))


def drawable_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select(*KEYS, "node_id")
    out = edges
    for end in ("src", "dst"):
        right = ids.withColumnsRenamed({k: f"_{k}" for k in KEYS})
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS] + [F.col(end) == F.col("node_id")]
        out = out.join(large(right), on, "left_semi")
    return out


def incomplete(graphs: DataFrame) -> DataFrame:
    """Which of the lists I, R, A, C, O of a graph are empty."""
    counts = node_counts(graphs)
    missing = F.filter(F.array(*(F.when(F.col(k.lower()) == 0, F.lit(k)) for k in S.NODE_TYPES[1:])), lambda x: x.isNotNull())
    return counts.select(*KEYS, F.array_join(missing, ",").alias("missing"))
