"""URL filters: block and allow entries in a trie over reversed host labels and path segments.

An entry names a host and the start of a path. It fits a url whose host is the entry's or one below it and whose path
starts with the entry's. The trie is walked from the last host label on; where it holds entries, the walk goes on
along the path's segments. Of the entries that fit, the longest wins: the one with the most host labels, then the one
with the longest path, and of equal ones the block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shipped

#: Bytes of entries in one trie that goes to the workers; longer lists are walked part by part.
PART_BYTES = 16 << 20
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in map(rest.find, "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


@dataclass(slots=True)
class _Node:
    below: dict[str, _Node] = field(default_factory=dict)
    #: The first node of the paths of the entries that name this host; on a path, ends of entries within the next segment.
    paths: _Node | None = None
    ends: dict[str, Rule] = field(default_factory=dict)
    reach: int = 0  # length of the longest end


class Trie:
    """Entries by reversed host labels, then by whole path segments; what follows an entry's last ``/`` is a start of the next segment."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for r in rules:
            node = self.root
            for label in reversed(r.host.split(".")):
                node = node.below.setdefault(label, _Node())
            node.paths = node = node.paths or _Node()
            *whole, rest = r.path.split("/")
            for segment in whole:
                node = node.below.setdefault(segment, _Node())
            if node.ends.get(rest, r).verdict != "block":
                node.ends[rest] = r
            else:
                node.ends.setdefault(rest, r)
            node.reach = max(node.reach, len(rest))

    def longest(self, host: str, path: str) -> Rule | None:
        hosts, node = [], self.root
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.paths:
                hosts.append(node.paths)
        segments = path.split("/")
        for node in reversed(hosts):
            found = None
            for i, segment in enumerate(segments):
                if node.ends:
                    ends = (segment[:k] for k in range(min(len(segment), node.reach), -1, -1))
                    found = next((node.ends[e] for e in ends if e in node.ends), found)
                node = node.below.get(segment) if i + 1 < len(segments) else None
                if node is None:
                    break
            if found:
                return found
        return None


def _parts(rules: Sequence[Rule]) -> Iterator[list[Rule]]:
    """Entries by order of their reversed hosts, in parts of bounded size."""
    part, size = [], 0
    for r in sorted(rules, key=lambda r: (r.host.split(".")[::-1], r.path)):
        part.append(r)
        size += len(r.host) + len(r.path) + 64
        if size > PART_BYTES:
            yield part
            part, size = [], 0
    if part or not rules:
        yield part


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule (the entry that decides, null if none fits), verdict.

    A null url, or one without ``://``, has an empty host and path, which no entry fits; so does an empty table without
    rows. Repeated rows are judged alike; a null key stays null; no other column is read, and texts of any length are read
    whole. A list beyond ``PART_BYTES`` is walked part by part over the table, each part's answer being held against the
    longest so far.
    """
    for r in rules:
        if r.verdict not in ("allow", "block") or not r.host or r.path[:1] not in ("", "/"):
            raise ValueError(f"not an entry: {r}")
    kind = pages.schema[key].dataType.simpleString()
    fields = ["key", "host", "path", "rule", "verdict", "labels"]
    parts = list(_parts([Rule(r.verdict, r.host.translate(_LOWER), r.path) for r in rules]))

    def step(df: DataFrame, part: list[Rule], first: bool) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(part)

        def run(batches):
            trie = Trie(held.value)
            for batch in batches:
                rows = []
                before = [(None, default, 0)] * batch.num_rows if first else list(zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True))
                split = map(split_url, batch.column(1).to_pylist()) if first else zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
                for (host, path), (rule, verdict, labels) in zip(split, before, strict=True):
                    r = trie.longest(host, path) if host else None
                    if r is not None:
                        own = r.host.count(".") + 1
                        rank, best = (own, len(r.path)), (labels, len(rule) - rule.index("/") if rule and "/" in rule else 0)
                        if rank > best or rank == best and r.verdict == "block" or rule is None:
                            rule, verdict, labels = str(r), r.verdict, own
                    rows.append((host, path, rule, verdict, labels))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = [pa.string()] * 4 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], fields)

        return df.transform(shipped).mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string, labels int")

    out = step(pages.select(F.col(key).alias("key"), F.col(url).alias("url")), parts[0], True)
    for part in parts[1:]:
        out = step(materialize(out), part, False)
    return out.select(F.col("key").alias(key), "host", "path", "rule", "verdict")
