"""Repair of broken JSON inside a task: a push-down automaton over the tokens of one text, in plain Python; Spark deals the texts out."""

from __future__ import annotations

import json
import re

import pandas as pd

# What follows a quote that ends its string: a closing bracket, a comma and another item, a string in its turn, or a line that begins an item.
_ITEM = r"""\s*(?:\Z|["'{\[\]},]|//|/\*|\#|\.{3}|-?[0-9]+\s*[,\]}]|[A-Za-z_]\w*\s*(?:[:,\]}]|\Z))"""
_ENDS = r"""(?:\s*(?:\Z|[\]}]|//|/\*|,""" + _ITEM + r"""|"[^"\n]*"\s*[,:\]}])|\s*\n\s*(?:["'{\[]|[A-Za-z_]\w*\s*:))"""


def _string(quote: str) -> str:
    """A key, or a string: quotes that don't end it are part of it, a next line with a key is not; the end may be missing."""
    key = quote + r"[^\\\n:{}\[\],QUOTE]{1,80}".replace("QUOTE", quote) + quote + r"(?=\s*:)"
    inside = r"[^\\\nQUOTE]++|\\(?s:.)|\n(?!\s*QUOTE[A-Za-z_]\w*QUOTE\s*:)|QUOTE(?!".replace("QUOTE", quote) + _ENDS + ")"
    return f"{key}|{quote}(?:{inside})*+{quote}?"


#: Tokens of what was meant as JSON: white space, comments, ellipses, strings, marks, and runs of anything else on a line.
LOOSE_TOKEN = r"\s++|//[^\n]*+|\#[^\n]*+|/\*(?s:.*?)(?:\*/|\Z)|\.{3,}|…|" + _string('"') + "|" + _string("'") + r"""|[\[\]{},:]|(?:(?!//|/\*|\s\#)[^"\[\]{},:\n])++"""
_TOKENS = re.compile(LOOSE_TOKEN, re.ASCII)
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_ODD = re.compile(r"""[\x00-\x1F"\\]""")
_ESCAPE = re.compile(r"""(\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))|[\x00-\x1F"\\]""")
_LIST = re.compile(r',?"(\w*)":', re.ASCII)
_OPENED = re.compile(r",?\{\Z")
_SPACE = " \t\n\r\f\v"
#: Words that stand for a value, and those of other languages for the same.
LITERALS = {"true": "true", "false": "false", "null": "null", "none": "null", "nan": "null", "undefined": "null"}
_MARKS = {m: (m, m) for m in "{}[],:"}
_CONTROL = {'"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": ""}
#: Fields without which a node or edge isn't one.
REQUIRED = {
    "facts": ("fid", "label"),
    "issues": ("iid", "label"),
    "rules": ("rid", "citation", "label", "jurisdiction"),
    "applications": ("aid", "rule_ref", "fact_refs", "issue_ref", "result", "reasoning"),
    "conclusions": ("cid", "determination"),
    "obligations": ("oid", "label", "required_by", "status", "jurisdiction"),
    "edges": ("eid", "src", "dst", "type"),
}


def _quoted(body: str) -> str:
    """The inside of a string as a JSON string: an escape that JSON lacks is its character, quotes and control characters are escaped."""
    return '"' + _ESCAPE.sub(lambda m: m[1] or _CONTROL.get(m[0], " "), body) + '"'


def loose_tokens(text: str) -> list[tuple[str, str]]:
    """The tokens of ``text`` as (kind, value): a mark is its own kind, ``s`` a string, ``w`` another value, ``x`` what the end cuts off; the value is JSON."""
    out, cut = [], False
    for t in _TOKENS.findall(text):
        first = t[0]
        if t in _MARKS:
            out.append(_MARKS[t])
            cut = False
        elif first in _SPACE or first == "#" or t.startswith(("//", "/*", "...", "…")):
            continue
        elif first in "\"'":
            t = t.rstrip(_SPACE)
            cut = len(t) < 2 or t[-1] != first or t[-2] == "\\" and (len(t) - 1 - len(t[1:-1].rstrip("\\"))) % 2 == 0
            body = t[1:].rstrip(_SPACE + ",") if cut else t[1:-1]
            out.append(("s", _quoted(body) if _ODD.search(body) else f'"{body}"'))
        else:
            t = t.rstrip(_SPACE)
            cut = True
            plain = LITERALS.get(t.lower()) or (t if _NUMBER.fullmatch(t) else None)
            out.append(("s", _quoted(t)) if plain is None else ("w", plain))
    if cut:
        out[-1] = ("x", out[-1][1])
    return out


def _closed(done: str, left: str, stack: str, key: str) -> str | None:
    """The text so far with its brackets closed. What is open inside a list (``left``) is kept if it has the fields that its list asks for, or if there is nothing else."""
    depth = len(stack)
    if not depth:
        return done
    if depth >= 3:
        bare = left.endswith("{")
        node, inner = _OPENED.sub("", left), stack[bare : depth - 2]
        name = _LIST.fullmatch(key)
        wanted = REQUIRED.get(name[1]) if name else None
        whole = wanted is None or "}" not in done
        if not whole:
            try:
                fields = json.loads(node.removeprefix(",") + inner, object_pairs_hook=list, parse_int=str, parse_float=str)
                whole = {k for k, v in fields if v is not None}.issuperset(wanted)
            except (ValueError, TypeError, RecursionError):
                pass
        if whole:
            return done + node + inner + stack[-2:]
    if done == "{":
        return None
    return (done if depth >= 3 else _OPENED.sub("", done)) + stack[-2:]


def repaired(text: str | None) -> str | None:
    """What was meant as a JSON object, as JSON; null without any object.

    Phases: in an object k (empty) and K expect a key, v and V its value (V: other items stand before it), n comes after an item; in an
    array a (empty) and A expect an item, m comes after one. Commas and colons are written with what they stand before. ``stack`` has
    the brackets to close, the innermost first; what is written inside a list's item is ``left`` until the item is whole.
    """
    if text is None:
        return None
    tokens = loose_tokens(text[max(text.find("{"), 0) :])
    if not tokens or tokens[0][0] != "{":
        return None
    kinds = [k for k, _ in tokens[1:]] + ["", ""]
    stack, phase, key, lists = "}", "k", "", ""
    done, left = ["{"], []
    for at, (k, v) in enumerate(tokens[1:], 1):
        if k == ":" or k == "x":
            continue
        n1 = kinds[at]
        scalar, depth = k == "s" or k == "w", len(stack)
        comma = "," if phase in "KnAm" else ""
        write, leave, enter, to, new, shut = "", 0, "", "", key, False
        if phase in "vV":
            if scalar and n1 == ":":
                to, new = phase, ("," if phase == "V" else "") + (f'"{v}":' if k == "w" else f"{v}:")
            elif scalar:
                write, to, new = key + v, "n", ""
            elif k in "{[":
                write, enter, new = key + k, "}" if k == "{" else "]", ""
            elif k == "}":
                write, leave, new = "}", 1, ""
            elif k == "]" and depth >= 3:
                write, leave, new = "}]", 2, ""
            elif k == ",":
                to, new = "k" if phase == "v" else "K", ""
            else:
                continue
        elif phase in "kKn":
            if scalar and (n1 == ":" or (phase != "n" and n1 and n1 in "sw{[")):
                to, new = "v" if phase == "k" else "V", comma + (f'"{v}":' if k == "w" else f"{v}:")
            elif k == "{" and depth >= 3:
                write, leave, enter, shut = ",{", 1, "}", True
            elif k == "}":
                write, leave = "}", 1
            elif k == "]" and depth >= 3:
                write, leave = "}]", 2
            elif k == "," and phase == "n":
                to = "K"
            else:
                continue
        else:
            inside = stack[1:2] == "}"
            if scalar and n1 == ":" and inside:
                write, leave, to, new = "]", 1, "V", "," + (f'"{v}":' if k == "w" else f"{v}:")
            elif scalar:
                write, to = comma + v, "m"
            elif k in "{[":
                write, enter = comma + k, "}" if k == "{" else "]"
            elif k == "]":
                write, leave = "]", 1
            elif k == "}" and inside and (depth >= 3 or n1 in ("", "}")):
                write, leave = "]}", 2
            elif k == "}" and n1 == "," and kinds[at + 1] == "s":
                write, leave = "]", 1
            elif k == "," and phase == "m":
                to = "A"
            else:
                continue
        if leave or enter:
            stack = enter + stack[leave:]
        if len(stack) == 1 and new and new != key:
            lists = new
        key = new
        if shut:  # the item before is whole
            done += left
            done.append("}")
            left = [write]
        elif write:
            left.append(write)
        if len(stack) <= 2:
            done += left
            left = []
        if to:
            phase = to
        elif enter:
            phase = "k" if enter == "}" else "a"
        elif stack:
            phase = "n" if stack[0] == "}" else "m"
        else:
            break
    return _closed("".join(done), "".join(left), stack, lists)


def repaired_all(texts: pd.Series) -> pd.Series:
    return texts.map(repaired, na_action="ignore")
