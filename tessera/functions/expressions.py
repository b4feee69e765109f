"""Column expressions: labels, weights, identifiers, citations, rounding. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import schema as S

#: White space includes the no-break space; letters and digits are Unicode's.
CITATION = r"(?i)(?:§|sec(?:tion|\.)?)[\s\x{00A0}]*([0-9A-Za-z][\p{L}\p{N}_\-.()]*)"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` has it inside a function of an array's elements."""
    return F.get(F.transform(F.array(value), body), 0)


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """A small fixed table as a CASE expression, which whole-stage code generation compiles."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def filled(c: Column) -> Column:
    """``c``, with the empty string as null."""
    return F.nullif(c, F.lit(""))


def student_of(agent_id: Column) -> Column:
    """The student that an agent id names: a key that is never null, empty for a graph without one."""
    return F.coalesce(agent_id, F.lit(""))


def node_type(node_id: Column) -> Column:
    """First character in upper case, ``?`` for an empty or null id."""
    return F.coalesce(filled(F.upper(F.substring(node_id, 1, 1))), F.lit("?"))


def label_of(label: Column, reasoning: Column, determination: Column, citation: Column) -> Column:
    return F.coalesce(filled(label), filled(reasoning), filled(determination), filled(citation), F.lit(""))


def node_weight(kind: Column, authority: Column) -> Column:
    """Weight of a type, for rules times that of its authority."""
    return lookup(kind, S.NODE_WEIGHTS, 1.0) * F.when(kind == "R", lookup(authority, S.AUTHORITY_WEIGHTS, 1.0)).otherwise(F.lit(1.0))


def edge_weight(src: Column, dst: Column) -> Column:
    """The larger weight of the ends there are; 1 without any."""
    return F.coalesce(F.greatest(src, dst), F.lit(1.0))


def tier_of_case(case_id: Column) -> Column:
    return lookup(F.substring(case_id, 1, 1), S.TIER_OF_PREFIX, "?")


def tier_order(tier: Column) -> Column:
    return lookup(tier, S.TIER_ORDER, 99)


def file_name() -> Column:
    """Name of the file that a row was read from; its path comes percent-encoded."""
    return F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("+"), F.lit("%2B")))


def citation_tokens(text: Column) -> Column:
    """Distinct section numbers cited in a text, lower case without closing marks."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"[.,;:]+$", ""))))


def citations_match(a: Column, b: Column) -> Column:
    return F.arrays_overlap(citation_tokens(a), citation_tokens(b))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def terms(words: Column) -> Column:
    """Words and pairs of adjacent words."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def half_even(value: Column, digits: int) -> Column:
    """Rounded on the scaled double, halves to even."""
    return F.rint(value * F.lit(10.0**digits)) / F.lit(10.0**digits)
