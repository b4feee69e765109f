"""Mixing sources to target weights by iterative proportional fitting.

A document weighs its white-space words, which stand for tokens here: no tokenizer is needed to weigh texts against
each other. The weights of cells (source, language, topic) are raked in turn to the three target marginals until all
hold; no cell gets more tokens than it has. Documents are then drawn by each cell's calibrated
probability, from a hash of the document, so that a repeated task draws the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shipped

#: What isn't named in a target goes by this name; the cells are as many as the targets' names allow.
OTHER = "other"
#: Topics are clusters of hashed word counts, fitted on all documents in so many rounds.
DIMENSIONS, ROUNDS = 1024, 12
#: Places of so many words are kept at most, for the length of a task: a worker is used again, also by other steps.
WORDS_KEPT = 50_000
#: Vectors are whole numbers of this part of 1, and a document's weight in a sum of this one; so sums are exact however rows are dealt.
SCALE, WEIGHT = 1 << 14, 1 << 10


@dataclass(frozen=True)
class Targets:
    """Target shares of tokens by source and language, and the share of all tokens to keep.

    Topics have no names to set shares by: theirs are their own shares to the power ``temper``, scaled to 1.
    """

    source: Mapping[str, float]
    lang: Mapping[str, float]
    topics: int = 8
    temper: float = 0.5
    keep: float = 0.5
    other: float = 0.01


class _Places(dict):
    def __missing__(self, word: str) -> int:
        at = zlib.crc32(word.encode()) % DIMENSIONS
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = at
        return at


_places = _Places()


def word_vector(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Unit vector of damped hashed word counts, as the places that aren't zero and what stands there times SCALE; and the number of words."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.int16), 0
    counts = np.bincount(list(map(_places.__getitem__, words)), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    damped = np.log1p(counts[at])
    return at.astype(np.uint16), np.rint(damped / np.linalg.norm(damped) * SCALE).astype(np.int16), len(words)


def _vectored(batches, place: int):
    try:
        for batch in batches:
            got = [word_vector(t.as_py()) for t in batch.column(place)]
            found = [pa.array([g[k].tobytes() for g in got], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found, pa.array([g[2] for g in got], pa.int64())], [*batch.schema.names, "at", "value", "n_tokens"])
    finally:
        _places.clear()


def with_vectors(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``at`` and ``value`` (:func:`word_vector`, as bytes) and ``n_tokens`` (words)."""
    place = docs.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", at binary, value binary, n_tokens long"

    return docs.transform(shipped).mapInArrow(lambda batches: _vectored(batches, place), schema)


def _dense(at: pa.Array, value: pa.Array) -> np.ndarray:
    sizes = [len(x) // 2 for x in at.to_pylist()]
    out = np.zeros((len(sizes), DIMENSIONS))
    places, values = (np.frombuffer(b"".join(x.to_pylist()), t) for x, t in ((at, np.uint16), (value, np.int16)))
    out[np.repeat(np.arange(len(sizes)), sizes), places] = values
    return out


@dataclass(frozen=True)
class Topics:
    """Mean vector of each language, and centroids of what differs from it; so topics cut across languages."""

    means: dict[str, np.ndarray]
    centroids: np.ndarray

    def nearest(self, vectors: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The topic of each vector, the first for one without words; and how long its difference from its language's mean is."""
        names = sorted(set(langs))
        means = np.stack([self.means[g] for g in names])
        lang = np.searchsorted(names, langs)
        dots = vectors @ self.centroids.T - (means @ self.centroids.T)[lang]
        square = (vectors * vectors).sum(1) - 2 * (vectors @ means.T)[np.arange(len(lang)), lang] + (means * means).sum(1)[lang]
        topic = np.round(dots / SCALE, 9).argmax(1)
        return np.where(vectors.any(1), topic, 0), np.sqrt(np.maximum(square, 0))


#: Documents that are made dense at once.
DENSE = 256


def _pieces(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, DENSE):
            yield batch.slice(at, DENSE)


def _sums(vectors: DataFrame, langs: list[str], topics: Topics | None) -> dict[int, np.ndarray]:
    """Exact sums over all documents, per topic, or per language where ``topics`` is None: of their vectors, and behind these of their
    weights by language. A weight scales what differs from the language's mean to length 1; without topics it is 1.

    A task adds up its rows and gives one row per topic; the driver gets as many rows as there are topics or languages.
    """
    width = DIMENSIONS + len(langs)

    def run(batches):
        total = np.zeros((len(langs) if topics is None else len(topics.centroids), width), np.int64)
        for batch in _pieces(batches):
            names = batch.column(0).to_pylist()
            x, lang = _dense(batch.column(1), batch.column(2)), np.searchsorted(langs, names)
            there = x.any(1)
            if topics is None:
                part, weight = lang, there.astype(float)
            else:
                part, length = topics.nearest(x, names)
                weight = np.rint(WEIGHT / np.maximum(length / SCALE, 1 / 64)) * there
            chosen = np.zeros((len(total), len(x)))
            chosen[part, np.arange(len(x))] = weight
            every = np.concatenate([x, np.eye(len(langs))[lang]], axis=1)
            total += (chosen @ every).astype(np.int64)  # whole numbers below 2 ** 53
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.int64()))], ["part", "total"])

    def add(rows: pa.Table) -> pa.Table:
        total = rows.column("total").combine_chunks().flatten().to_numpy().reshape(len(rows), width).sum(0)
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "total": pa.array([total], pa.list_(pa.int64()))})

    rows = vectors.select("lang_cell", "at", "value").transform(shipped).mapInArrow(run, "part int, total array<bigint>")
    return {r["part"]: np.array(r["total"]) for r in rows.groupBy("part").applyInArrow(add, "part int, total array<bigint>").collect()}


def fit_topics(vectors: DataFrame, topics: int, rounds: int = ROUNDS) -> Topics:
    """Spherical k-means over all documents (lang_cell, at, value) as distributed sums: of each language for its mean, then of each topic in
    each round, until none changes. It starts at the first ``topics`` different vectors in order of their hash; a topic that
    loses all its documents stays where it was. The driver holds a vector for each language and topic, and those it starts at."""
    langs = sorted(r[0] for r in vectors.select("lang_cell").distinct().collect())  # the targets' names
    told = vectors.where("at <> X''").select("at", "value", "lang_cell", F.xxhash64("at", "value", "lang_cell").alias("h")).orderBy("h", "lang_cell").limit(8 * topics).collect()
    starts = list({(bytes(r["at"]), bytes(r["value"]), r["lang_cell"]): r for r in told}.values())
    if not starts:
        return Topics({g: np.zeros(DIMENSIONS) for g in langs}, np.zeros((topics, DIMENSIONS)))
    sums = _sums(vectors, langs, None)
    means = {g: sums[k][:DIMENSIONS] / max(sums[k][DIMENSIONS + k], 1) for k, g in enumerate(langs)}

    def unit(x: np.ndarray) -> np.ndarray:
        return x / (np.linalg.norm(x) or 1)

    first = _dense(pa.array([bytes(r["at"]) for r in starts]), pa.array([bytes(r["value"]) for r in starts]))
    each = [unit(x - means[r["lang_cell"]]) for x, r in zip(first, starts, strict=True)]
    found = Topics(means, np.stack([each[t % len(each)] for t in range(topics)]))
    for _ in range(rounds):
        sums = _sums(vectors, langs, found)
        moved = found.centroids.copy()
        for t in range(topics):
            weights = sums[t][DIMENSIONS:]
            if weights.any():
                moved[t] = unit(sums[t][:DIMENSIONS] - sum(w * means[g] for w, g in zip(weights, langs, strict=True)))
        if np.array_equal(moved, found.centroids):
            break
        found = Topics(means, moved)
    return found


def with_topics(docs: DataFrame, topics: Topics) -> DataFrame:
    """``docs`` (with lang_cell, at and value) with ``topic`` in place of ``at`` and ``value``."""
    kept = [c for c in docs.columns if c not in ("at", "value")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept) + ", topic int"

    def run(batches):
        for batch in _pieces(batches):
            topic, _ = topics.nearest(_dense(batch.column("at"), batch.column("value")), batch.column("lang_cell").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(topic, pa.int32())], [*kept, "topic"])

    return docs.transform(shipped).mapInArrow(run, schema)


def rake(tokens: np.ndarray, marginals: list[np.ndarray], keep: float, rounds: int = 500, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Tokens to keep per cell, and the largest difference of a marginal's share from its target.

    Iterative proportional fitting from the cells' own tokens, each held at what it has. Targets of categories
    without tokens go to the others in proportion. Targets that can't all be met get the round that came nearest.
    """
    total = tokens.sum()
    if not total:
        return np.zeros_like(tokens), 0.0
    axes = range(tokens.ndim)
    wants = []
    for a, m in zip(axes, marginals, strict=True):
        there = tokens.sum(axis=tuple(b for b in axes if b != a)) > 0
        m = np.where(there, m, 0.0)
        m = m if m.sum() else there.astype(float)
        wants.append(m / m.sum() * keep * total)
    x, error = tokens * keep, np.inf
    best, least = x, np.inf  # where the targets can't be met, further rounds may lead away from them
    for _ in range(rounds):
        for a, want in zip(axes, wants, strict=True):
            rest = tuple(b for b in axes if b != a)
            has = x.sum(axis=rest)
            factor = np.divide(want, has, out=np.zeros_like(want), where=has > 0)
            x = np.minimum(tokens, x * np.expand_dims(factor, rest))
        last, error = error, max(float(np.abs(x.sum(axis=tuple(b for b in axes if b != a)) - w).max()) / (keep * total) for a, w in zip(axes, wants, strict=True))
        if error < least:
            best, least = x, error
        if error < tolerance or abs(last - error) < tolerance * 1e-3:
            break
    return best, least


def probabilities(cells: DataFrame, targets: Targets) -> DataFrame:
    """Per cell (source_cell, lang_cell, topic): ``probability``, and ``rake_error``, the largest difference of a raked
    marginal's share from its target, the same on all rows: 0 where the targets can be met with the tokens there are.

    ``cells`` holds source_cell, lang_cell, topic, n_tokens.
    """
    spark = cells.sparkSession
    sources, langs = [*targets.source, OTHER], [*targets.lang, OTHER]
    tokens = np.zeros((len(sources), len(langs), targets.topics))
    for r in cells.groupBy("source_cell", "lang_cell", "topic").agg(F.sum("n_tokens").alias("n")).collect():  # at most tokens.size rows
        tokens[sources.index(r["source_cell"]), langs.index(r["lang_cell"]), r["topic"]] = r["n"]
    wants = [np.array([*targets.source.values(), targets.other]), np.array([*targets.lang.values(), targets.other]), tokens.sum(axis=(0, 1)) ** targets.temper]
    kept, error = rake(tokens, wants, targets.keep)
    p = np.divide(kept, tokens, out=np.full_like(tokens, targets.keep), where=tokens > 0)
    out = [(s, l, t, float(p[i, j, t]), float(error)) for i, s in enumerate(sources) for j, l in enumerate(langs) for t in range(targets.topics)]
    return spark.createDataFrame(out, "source_cell string, lang_cell string, topic int, probability double, rake_error double")


def _celled(docs: DataFrame, targets: Targets) -> DataFrame:
    def cell(c: str, names):
        return F.when(F.col(c).isin(*names), F.col(c)).otherwise(OTHER)

    return docs.withColumn("source_cell", cell("source", targets.source)).withColumn("lang_cell", cell("lang", targets.lang))


def _draw(rows: DataFrame, plan: DataFrame) -> DataFrame:
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", "crc", F.lit("mix")), 11) / F.lit(float(1 << 53))
    return rows.join(F.broadcast(plan), ["source_cell", "lang_cell", "topic"]).withColumn("kept", mark < F.col("probability"))


def mix(docs: DataFrame, targets: Targets) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, kept, rake_error.

    Null or unnamed sources and languages count as ``other``; a text without words goes to the first topic and
    weighs nothing. A target without any rows goes to the others of its kind in proportion. Repeated rows are drawn
    alike. A document is kept if its hash, as a number from 0 to 1, is below its probability, so one of probability 0
    never is and one of probability 1 always. Columns besides doc_id, text, source and lang aren't read.
    """
    rows = _celled(docs.select("doc_id", "text", "source", "lang"), targets)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    told = materialize(with_vectors(rows.withColumn("crc", crc)).drop("text"))
    small = materialize(with_topics(told, fit_topics(told, targets.topics)))
    drawn = _draw(small, probabilities(small, targets))
    return drawn.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept", "rake_error")


def sample(docs: DataFrame, targets: Targets) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns. The rows are written once with their vectors and tokens, which
    the fit of topics, the weighing of cells and the drawing then read."""
    columns, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    names = dict(zip(columns, inner, strict=True))
    work = _celled(docs.toDF(*inner).withColumns({c: F.col(names[c]) for c in ("doc_id", "source", "lang")}), targets)
    crc = F.crc32(F.encode(F.coalesce(F.col(names["text"]), F.lit("")), "UTF-8"))
    told = materialize(with_vectors(work.drop("source", "lang").withColumn("crc", crc), names["text"]))
    topics = fit_topics(told, targets.topics)
    cells = with_topics(told.select("source_cell", "lang_cell", "n_tokens", "at", "value"), topics)
    labelled = with_topics(told, topics)
    return _draw(labelled, probabilities(cells, targets)).where("kept").select(*(F.col(i).alias(c) for c, i in names.items()))
