"""From a model's answer to a checked graph: split, unwrap, decode, repair, validate.

A response that can't be used becomes a row of the rejects with its reason; nothing raises.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions.expressions import filled
from tessera.functions.tables import ship, small_batches
from tessera.operators import repair

FENCE = "```"


def split_response(text: Column) -> tuple[Column, Column]:
    """Prose and graph part: cut at the first marker, else from the first brace to the last; null without either."""
    marked = text.contains(S.JSON_MARKER)
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((first > 0) & text.contains("}") & (last >= first), F.substring(text, first, last - first + 1))
    at = F.instr(text, S.JSON_MARKER)
    prose = F.when(marked, F.substring(text, F.lit(1), at - 1)).when(braces.isNotNull(), F.substring(text, F.lit(1), first - 1)).otherwise(text)
    return prose, F.when(marked, F.substring(text, at + len(S.JSON_MARKER), F.length(text))).otherwise(braces)


def strip_fence(blob: Column) -> Column:
    """Without a leading fence line and without the last later line that begins with a fence and what follows it.

    Outside a fence the end stays as it is: where an answer is cut off, white space there is part of its unfinished string.
    """
    trimmed = F.regexp_replace(blob, r"^\s+|\s+$", "")
    body = F.regexp_replace(trimmed, r"(?s)^\x60{3}[^\n]*\n?", "")
    return F.when(trimmed.startswith(FENCE), F.regexp_replace(body, r"(?s)(^|\n)\s*\x60{3}(?!.*\n\s*\x60{3}).*$", "")).otherwise(F.regexp_replace(blob, r"^\s+", ""))


def view_split(text: Column) -> tuple[Column, Column]:
    """Prose and graph text as shown to a reader; null for a part that isn't there."""
    space = r"^\s+|\s+$"
    marked, at = text.contains(S.JSON_MARKER), F.instr(text, S.JSON_MARKER)
    after = F.regexp_replace(F.substring(text, at + len(S.JSON_MARKER), F.length(text)), space, "")
    brace = F.instr(after, "{")
    after = F.when(brace > 1, F.substring(after, brace, F.length(after))).otherwise(after)
    bare = F.regexp_replace(text, space, "")
    json_only = bare.startswith("{")
    prose = F.when(marked, filled(F.regexp_replace(F.substring(text, F.lit(1), at - 1), space, ""))).when(~json_only, bare)
    return prose, F.when(marked, filled(after)).when(json_only, bare)


def _fix(items: str, edit: Callable[[Column], dict[str, Column]]) -> Column:
    def one(x: Column) -> Column:
        out = x
        for name, value in edit(x).items():
            out = out.withField(name, value)
        return out

    return F.transform(F.col(items), one)


def _bad(c: Column, allowed: str) -> Column:
    return c.isNotNull() & ~c.isin(*S.ENUMS[allowed])


def sanitize(graphs: DataFrame) -> DataFrame:
    """Unknown values become safe defaults; ``changes`` tells each change, in list order, ``n_changes`` how many.

    A missing determination is left as it is, for validation to reject.
    """
    q = F.coalesce

    def told(items: str, says: Callable[[Column], list[tuple[Column, Column]]]) -> Column:
        notes = F.transform(F.col(items), lambda x: F.array(*(F.when(cond, msg) for cond, msg in says(x))))
        return q(F.filter(F.flatten(notes), lambda m: m.isNotNull()), F.array().cast("array<string>"))

    def swap(kind: str, x: Column, key: str, what: str, default: str) -> Column:
        return F.concat(F.lit(f"{kind} "), q(x[key], F.lit("?")), F.lit(f": {what} '"), x[what], F.lit(f"' → '{default}'"))

    def conclusion(x: Column) -> list[tuple[Column, Column]]:
        head = F.concat(F.lit("conclusion "), q(x["cid"], F.lit("?")))
        return [
            (x["support_refs"].isNull(), F.concat(head, F.lit(": added missing support_refs=[]"))),
            (_bad(x["confidence"], "confidence"), swap("conclusion", x, "cid", "confidence", "medium")),
            (x["confidence"].isNull(), F.concat(head, F.lit(": added missing confidence='medium'"))),
            (_bad(x["determination"], "determination"), swap("conclusion", x, "cid", "determination", "conditional")),
        ]

    changes = F.concat(
        told("edges", lambda x: [(_bad(x["type"], "edge_type"), swap("edge", x, "eid", "type", "supports"))]),
        told("conclusions", conclusion),
        told("rules", lambda x: [(_bad(x["authority"], "authority"), swap("rule", x, "rid", "authority", "binding"))]),
        told("applications", lambda x: [(_bad(x["result"], "result"), swap("application", x, "aid", "result", "partial"))]),
    )

    def safe(c: Column, allowed: str, default: str) -> Column:
        return F.when(_bad(c, allowed), default).otherwise(c)

    out = graphs.withColumn("changes", changes).withColumn("n_changes", F.size("changes").cast("long"))
    return out.withColumns(
        {
            "edges": _fix("edges", lambda x: {"type": safe(x["type"], "edge_type", "supports")}),
            "conclusions": _fix(
                "conclusions",
                lambda x: {
                    "support_refs": q(x["support_refs"], F.array().cast("array<string>")),
                    "confidence": q(safe(x["confidence"], "confidence", "medium"), F.lit("medium")),
                    "determination": safe(x["determination"], "determination", "conditional"),
                },
            ),
            "rules": _fix("rules", lambda x: {"authority": safe(x["authority"], "authority", "binding")}),
            "applications": _fix("applications", lambda x: {"result": safe(x["result"], "result", "partial")}),
        }
    )


def with_defaults(graphs: DataFrame) -> DataFrame:
    """Fields that may be left out get their default, and missing lists are empty."""
    q = F.coalesce
    out = graphs.withColumns(
        {
            "facts": _fix("facts", lambda x: {"polarity": q(x["polarity"], F.lit("present"))}),
            "issues": _fix("issues", lambda x: {"status": q(x["status"], F.lit("dispositive"))}),
            "rules": _fix("rules", lambda x: {"authority": q(x["authority"], F.lit("binding"))}),
            "conclusions": _fix("conclusions", lambda x: {"confidence": q(x["confidence"], F.lit("medium"))}),
        }
    )
    return out.withColumns({c: q(F.col(c), F.array()) for c in [*(c for c, _ in S.NODE_LISTS.values()), "edges"]})


VIOLATION = "array<struct<kind:string,item:string,detail:string>>"


def broken_rules(ids: Column) -> Column:
    """All broken rules of a graph as an array of (kind: id, enum, required or edge_ref; item; detail), in list order.

    ``ids`` has the ids of the graph's own nodes; edge ends are held against them inside the row, without a join.
    """
    q, none = F.coalesce, F.array().cast(VIOLATION)

    def note(kind: str, item: Column, detail: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), q(item, F.lit("?")).alias("item"), detail.alias("detail")))

    def checks(items: str, key: str, letter: str, enums: dict[str, str], required: tuple[str, ...]) -> Column:
        def one(x: Column) -> Column:
            notes = [note("id", x[key], F.lit(f"not {letter} and a number"), ~q(x[key].rlike(f"^{letter}[0-9]+$"), F.lit(False)))]
            notes += [note("enum", x[key], F.concat(F.lit(f"{f}="), x[f]), _bad(x[f], e)) for f, e in enums.items()]
            notes += [note("required", x[key], F.lit(f), x[f].isNull()) for f in required]
            return F.array(*notes)

        return q(F.flatten(F.transform(F.col(items), one)), none)

    def ends(x: Column) -> Column:
        return F.array(*(note("edge_ref", x["eid"], F.concat(F.lit(f"{e}="), q(x[e], F.lit(""))), ~q(F.array_contains(ids, x[e]), F.lit(False))) for e in ("src", "dst")))

    found = F.concat(
        checks("facts", "fid", "F", {"polarity": "polarity"}, ("label",)),
        checks("issues", "iid", "I", {"status": "issue_status"}, ("label",)),
        checks("rules", "rid", "R", {"authority": "authority"}, ("citation", "label", "jurisdiction")),
        checks("applications", "aid", "A", {"result": "result"}, ("rule_ref", "fact_refs", "issue_ref", "result", "reasoning")),
        checks("conclusions", "cid", "C", {"determination": "determination", "confidence": "confidence"}, ("determination", "support_refs")),
        checks("obligations", "oid", "O", {"status": "obligation_status"}, ("label", "required_by", "status", "jurisdiction")),
        checks("edges", "eid", "E", {"type": "edge_type"}, ("src", "dst", "type")),
        q(F.flatten(F.transform("edges", ends)), none),
    )
    return F.filter(found, lambda x: x.isNotNull())


def node_ids() -> Column:
    return F.concat(*(F.coalesce(F.col(c)[k], F.array().cast("array<string>")) for c, k in S.NODE_LISTS.values()))


def violations(graphs: DataFrame) -> DataFrame:
    """One row per broken rule: case_id, source, agent_id, kind (id, enum, required, edge_ref), item, detail."""
    keys = ["case_id", "source", "agent_id"]
    return graphs.withColumn("ids", node_ids()).select(*keys, F.explode(broken_rules(F.col("ids"))).alias("v")).select(*keys, "v.*")


# --- repair ----------------------------------------------------------------------------------------------------------

@lru_cache(1)
def _repair() -> Callable[[Column], Column]:
    return F.pandas_udf(repair.repaired_all, "string")


def repair_json(blob: Column) -> Column:
    """What was meant as a JSON object, as JSON: a push-down automaton over its tokens that goes on where the text breaks its rules.

    It supplies missing commas, colons and brackets, drops commas that are too many, comments and ellipses, puts quotes around bare
    keys and words, reads single quotes and the words of other languages for true, false and null, escapes quotes and line feeds inside
    strings, and leaves out keys without a value, stray words and what follows the object. Where the text is cut off, what is unfinished
    goes: a key, a string, a node that lacks required fields (unless it is the only one); open brackets are closed. Null without any object.
    """
    ship(SparkSession.active())
    return _repair()(blob)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` computed once a row, whatever later filters and projections make of them."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", F.explode(F.array(made)).alias("_once")).select(*df.columns, "_once.*")


def checked_responses(responses: DataFrame) -> DataFrame:
    """Every response (case_id, source, model_name, agent_id, text) with the graph decoded from it: the graph's lists,
    ``changes``, ``n_changes``, ``repaired``, ``blob``, and ``reason``, why it can't be used (null for valid graphs).

    Each row is decided on its own, so responses that share ids don't touch each other. The payload's own metadata is
    overwritten by the response's.
    """
    meta = ["case_id", "source", "model_name", "agent_id"]
    lists = [*(c for c, _ in S.NODE_LISTS.values()), "edges"]
    ddl, mode = S.GRAPH_DDL + ", _broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    small_batches(responses.sparkSession)
    _, blob = split_response(F.col("text"))
    rows = once(responses.select(*meta, "text"), blob=strip_fence(blob))
    rows = once(rows, g=F.from_json("blob", ddl, mode))
    broken = F.col("blob").isNotNull() & (F.col("g").isNull() | F.col("g._broken").isNotNull())
    # Python sees a text only where it is broken
    rows = rows.withColumn("fixed", repair_json(F.when(broken, F.col("blob"))))
    rows = once(rows, mended=F.from_json("fixed", ddl, mode)).drop("fixed")
    empty = F.lit(True)
    for c in lists[:-1]:
        empty = empty & (F.coalesce(F.size(F.col(f"mended.{c}")), F.lit(0)) <= 0)
    usable = F.col("mended").isNotNull() & F.col("mended._broken").isNull() & ~empty
    reason = F.when(F.col("blob").isNull(), "no graph found").when(broken & ~usable, "graph can't be decoded")
    rows = once(rows, reason=reason, repaired=broken & usable, h=F.when(broken, F.col("mended")).otherwise(F.col("g")))
    rows = rows.select(*meta, F.substring(F.coalesce("blob", "text"), 1, 500).alias("excerpt"), "reason", "repaired", *(F.col(f"h.{c}").alias(c) for c in lists))
    fixed = with_defaults(sanitize(rows))
    found = F.when(F.col("reason").isNull(), broken_rules(node_ids()))
    told = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda v: F.concat_ws(" ", v["kind"], v["item"], v["detail"])))), "; ")
    return once(fixed, _told=F.nullif(told, F.lit(""))).withColumn("reason", F.coalesce("reason", "_told")).drop("_told")


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid graphs, rejects) of ``responses`` (case_id, source, model_name, agent_id, text).

    Rejects carry a reason and the first 500 characters of what couldn't be used. A graph whose JSON had to be mended
    says so in ``repaired``.
    """
    return split_checked(checked_responses(responses))


def split_checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid graphs and rejects of checked responses; who writes both should write ``rows`` once before, so that they are decoded once."""
    return rows.where("reason is null").drop("reason", "excerpt"), rows.where("reason is not null").select("case_id", "source", "model_name", "agent_id", "reason", "excerpt")


def build_prompt(template: Column, statutes: Column, facts: Column, question: Column) -> Column:
    """The template with its slots filled one after another, so that filled-in text is searched for later slots."""
    out = F.replace(template, F.lit("<<STATUTES>>"), statutes)
    out = F.replace(out, F.lit("<<CASE_FACTS>>"), facts)
    return F.replace(out, F.lit("<<CASE_QUESTION>>"), question)
