"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash find candidates, whole sets decide.

SimHash's covering tables (:mod:`simhash`) find every pair of fingerprints within their radius; of the pairs at 0.8 most lie
beyond it, and MinHash finds these.

Two texts are near copies where the sets of their 5-word shingles (words between white space, in lower case) have
a similarity of at least 0.8. Texts with one set are one node. 30 tables of 5 minima each miss a pair at
0.8 with a probability of (1 - 0.8 ** 5) ** 30 = 7e-6, and closer pairs more rarely; each candidate pair is then
decided on the sets of both, so no pair below the threshold links.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import materialize, shipped
from tessera.llm.components import connected_components

SHINGLE, SEED = 5, 42
#: Near copies share at least this part of all shingles of both: 4 of 5.
NUM, DEN = 4, 5
TABLES, MINIMA = 30, 5
#: Buckets of up to so many nodes give pairs; larger ones are compared in blocks of about BLOCK nodes.
PAIRED, BLOCK = 32, 256
#: Columns of a block's table of shared shingles, at most.
WIDTH = 4096

_RNG = np.random.default_rng(23)
_A = _RNG.integers(0, 2**63, TABLES * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 2**63, (TABLES, MINIMA), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the text's different shingles, ascending; all words are one shingle where they are too few."""
    parts, few = [], []
    hash_ = xxhash.xxh64_intdigest
    for words in simhash._blocks((text or "").encode().lower(), SHINGLE):
        if len(words) < SHINGLE:
            few = words
            continue
        line = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
        starts = [0, *[e + 1 for e in ends]]
        parts.append(np.unique(np.array([hash_(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)], np.uint64)))
    if not parts:
        return np.array([hash_(b" ".join(few), SEED)] if few else [], np.uint64)
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def buckets(found: np.ndarray) -> np.ndarray:
    """The bucket of a set in each table; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    low = np.full(len(_A), 2**64 - 1, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(low, np.multiply.outer(_A, found[at : at + 1024]).min(axis=1), out=low)
    return (low.reshape(TABLES, MINIMA) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)))


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``mark`` (:func:`simhash.text_mark`), ``node`` (a hash of the text's set), its size, its buckets and its SimHash ``fp``."""

    def run(batches):
        for batch in batches:
            nodes, sizes, each, fps = [], [], [], []
            for t in batch.column(2):
                found = shingles(t.as_py())
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0)
                sizes.append(len(found))
                each.append(buckets(found))
                fps.append(simhash.fingerprint(t.as_py()))
            node = pa.array(np.array(nodes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array(sizes, pa.int64()), _lists(each), pa.array(np.array(fps, np.uint64).view(np.int64))], ["key", "mark", "node", "size", "buckets", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("key"), simhash.text_mark(text).alias("mark"), F.col(text).alias("text"))
    return rows.transform(shipped).mapInArrow(run, "key long, mark long, node long, size long, buckets array<bigint>, fp long")


def _sets(batches):
    for batch in batches:
        for i in range(batch.num_rows):  # one text at a time, as a batch's sets may be larger than its texts
            found = shingles(batch.column(1)[i].as_py()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), _lists([found])], ["node", "found"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.flatnonzero(times > 1)  # a shingle of one set is shared by none
    place = np.full(len(values), -1)
    place[often] = np.arange(len(often))
    column = place[which]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, len(often), WIDTH):
        a, b = np.searchsorted(column, [at, at + WIDTH])
        m = np.zeros((len(sets), WIDTH), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _compare(table: pa.Table) -> pa.Table:
    """Links of a spanning forest over the nodes of two blocks of a bucket."""
    node, found = table.column("node").to_numpy(), table.column("found").combine_chunks()
    flat, ends = found.flatten().to_numpy(), found.offsets.to_numpy() - found.offsets[0].as_py()
    sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    size = np.diff(ends).astype(np.int64)
    u, v = simhash.spanning(node, (NUM + DEN) * _shared(sets) >= NUM * (size[:, None] + size[None, :]))
    return pa.table({"u": pa.array(u), "v": pa.array(v)})


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates ``u``, ``v``, ``both`` (the sizes' sum) of ``nodes`` (node, size, fp): neighbours of equal fingerprints, and first nodes of
    fingerprints that covering tables link. Nodes of one fingerprint are chained, not paired with one of them."""
    told = nodes.where("size > 0").select("fp", F.struct("node", "size").alias("x"))
    order = Window.partitionBy("fp").orderBy("x.node")
    chain = materialize(told.withColumn("before", F.lag("x").over(order)))
    first = chain.where("before is null").select("fp", "x")
    near = simhash.links(first.select("fp"))
    one, other = (first.select(F.col("fp").alias(c), F.col("x").alias(f"{c}x")) for c in "uv")
    met = near.join(one, "u").join(other, "v").select(F.col("ux").alias("a"), F.col("vx").alias("b"))
    met = met.unionByName(chain.where("before is not null").select(F.col("before").alias("a"), F.col("x").alias("b")))
    close = DEN * F.least("a.size", "b.size") >= NUM * F.greatest("a.size", "b.size")
    return met.where(close).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"), (F.col("a.size") + F.col("b.size")).alias("both"))


def links(docs: DataFrame, nodes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Links ``u``, ``v`` that connect the nodes chained by a similarity of at least NUM / DEN."""
    each = nodes.select("node", "size", F.explode("buckets").alias("b"))
    members = materialize(each.withColumn("n", F.count("*").over(Window.partitionBy("b"))).where("n > 1"))
    together = members.where(F.col("n") <= PAIRED).groupBy("b").agg(F.collect_list(F.struct("node", "size")).alias("m"))
    near = F.filter("m", lambda y: (y["node"] > F.col("x.node")) & (DEN * F.least(y["size"], F.col("x.size")) >= NUM * F.greatest(y["size"], F.col("x.size"))))
    pairs = together.select("m", F.explode("m").alias("x")).select("x", F.explode(near).alias("y"))
    pairs = pairs.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"), (F.col("x.size") + F.col("y.size")).alias("both"))
    pairs = materialize(simhash_pairs(nodes).unionByName(pairs).distinct())
    crowded = members.where(F.col("n") > PAIRED).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).unionByName(crowded.select("node")).distinct()
    wanted = wanted.join(nodes.select("node", "first"), "node").select("node", *(c.alias(n) for n, c in simhash.told(F.col("first.key"), F.col("first.mark")).items()))
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumns(simhash.told(F.col("key"), simhash.text_mark())).drop("key")
    texts = texts.join(wanted, ["k", "none", "m"]).select("node", "text").dropDuplicates(["node"])
    sets = materialize(texts.transform(shipped).mapInArrow(_sets, "node long, found array<bigint>"))
    one, other = (sets.select(F.col("node").alias(c), F.col("found").alias(f"{c}s")) for c in "uv")
    common = F.size(F.array_intersect("us", "vs"))
    out = pairs.join(one, "u").join(other, "v").where((NUM + DEN) * common >= NUM * F.col("both")).select("u", "v")
    dealt = crowded.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("b", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node").join(sets, "node")
    return out.unionByName(dealt.transform(shipped).groupBy("b", "i", "j").applyInArrow(_compare, "u long, v long")).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, mark and ``best``, as :func:`simhash.classes` has them. Texts without words are copies of each other."""
    rows = materialize(signatures(docs, key, text))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("first")
    nodes = materialize(rows.groupBy("node").agg(first, F.first("size").alias("size"), F.first("buckets").alias("buckets"), F.min("fp").alias("fp")))
    joined = connected_components(links(docs, nodes, key, text))
    parts = nodes.select("node", "first").join(joined, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    low = parts.groupBy("component").agg(F.min("first").alias("best"))
    return rows.select("key", "mark", "node").join(parts.join(low, "component").select("node", "best"), "node").select("key", "mark", "best")
