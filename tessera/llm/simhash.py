"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016).

A fingerprint bit is the majority of that bit over the XXH64 hashes of a text's word shingles. Bits are
given codes of r+1 binary digits; for each of the 2**(r+1)-1 non-zero masks v, a table keeps the bits whose
code has an odd product with v. The codes of r differing bits span too little to meet every v, so
every pair within radius r agrees on all kept bits of some table: no pair is missed.

Only distinct fingerprints are put in tables. A bucket with many of them is split by further masks over
its free bits, which keep the same guarantee; each split halves the free bits. Buckets that are still large
after the last split meet block by block, so no bucket is gathered in one place.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shipped
from tessera.llm.components import connected_components

BITS, SHINGLE, RADIUS, SEED = 64, 4, 4, 42
#: Buckets of more distinct fingerprints are split, at most so many times.
BUCKET, SPLITS = 256, 2
#: Texts are hashed in blocks of about so many bytes, so that a text's words need little memory.
BLOCK = 4 << 20

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _blocks(data: bytes, shingle: int = SHINGLE):
    """Lists of words, each with the last words of the list before it so that every shingle is whole in one."""
    at, carry = 0, []
    while at < len(data):
        end = len(data)
        if end - at > BLOCK and (m := _SPACE.search(data, at + BLOCK)):
            end = m.start()
        words = carry + data[at:end].split()
        yield words
        carry = words[-(shingle - 1) :]
        at = end


def fingerprint(text: str | None) -> int:
    """The text's 64-bit fingerprint; 0 for a text without words."""
    data = (text or "").encode().lower()
    total, ones, few = 0, np.zeros(BITS, np.int64), []
    hash_ = xxhash.xxh64_intdigest
    for words in _blocks(data):
        if len(words) < SHINGLE:
            few = words
            continue
        line = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
        starts = [0, *[e + 1 for e in ends]]
        h = np.array([hash_(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)], np.uint64)
        octets = h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
        ones += (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS).ravel()
        total += len(h)
    if not total:
        return hash_(b" ".join(few), SEED) if few else 0
    return int((2 * ones > total) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def text_mark(text: str = "text") -> Column:
    """A hash of the whole text, which tells rows that share a key apart; null texts count as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``mark`` (:func:`text_mark`) and ``fp``, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["key", "mark", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_mark(text).alias("mark"), F.col(text).alias("text"))
    return rows.transform(shipped).mapInArrow(run, "key long, mark long, fp long")


def masks(free: int = 2**BITS - 1, radius: int = RADIUS, seed: int = 7) -> list[int]:
    """Masks over the ``free`` bits, one a table, such that any ``radius`` free bits are all unkept in some mask."""
    bits = [b for b in range(BITS) if free >> b & 1]
    random.Random(seed).shuffle(bits)
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(len(bits))]
    return [sum(1 << b for b, c in zip(bits, codes, strict=True) if (c & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def forest(members: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over a bucket's fingerprints within the radius, each to its tree's root."""
    x = members.view(np.uint64)
    return spanning(members, np.bitwise_count(x[:, None] ^ x[None, :]) <= radius)


def spanning(members: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over members by their table of who is near whom, each to its tree's root."""
    open_, us, vs = np.ones(len(members), bool), [], []
    while open_.any():
        root = int(open_.argmax())
        open_[root], edge = False, [root]
        while edge:
            found = np.flatnonzero(near[edge.pop()] & open_)
            open_[found] = False
            edge += found.tolist()
            us.append(members[found])
            vs.append(np.full(len(found), members[root]))
    return np.concatenate(us), np.concatenate(vs)


def _forests(batches):
    for batch in batches:
        members = batch.column(0)
        flat, ends = members.flatten().to_numpy(), members.offsets.to_numpy() - members.offsets[0].as_py()
        pairs = [forest(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*pairs, strict=True)], ["u", "v"])


def links(distinct: DataFrame, bucket: int = BUCKET, splits: int = SPLITS) -> DataFrame:
    """Links ``u``, ``v`` that connect exactly the fingerprints (column ``fp``, distinct) chained within the radius.

    Every pair within the radius is compared in some bucket; a bucket gives a spanning forest of its pairs and
    not the pairs themselves.
    """
    spark = distinct.sparkSession
    top = masks()
    levels: list[list[tuple[int, int, int]]] = [[(0, i, m) for i, m in enumerate(top)]]  # (parent, table, kept bits)
    for _ in range(splits):
        made, n = [], 0
        for _, parent, kept in levels[-1]:
            for m in masks(~kept & (2**BITS - 1), seed=parent + 11):
                made.append((parent, n, kept | m))
                n += 1
        levels.append(made)
    out = rows = None
    for depth, level in enumerate(levels):
        if depth == 0:
            each = [F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bucket")) for _, t, m in level]
            keyed = distinct.select("fp", F.explode(F.array(*each)).alias("t")).select("fp", "t.table", "t.bucket")
        else:
            table = F.broadcast(spark.createDataFrame([(p, t, _signed(m)) for p, t, m in level], "parent int, next int, kept bigint"))  # 31 ** (depth + 1) rows
            keyed = rows.join(table, F.col("table") == F.col("parent")).select("fp", F.col("next").alias("table"), F.col("fp").bitwiseAND(F.col("kept")).alias("bucket"))
        keyed = keyed.withColumn("n", F.count("*").over(Window.partitionBy("table", "bucket"))).where("n > 1")
        last = depth == len(levels) - 1
        keyed = materialize(keyed)
        whole = keyed.where(F.col("n") <= bucket).groupBy("table", "bucket").agg(F.collect_list("fp").alias("members"))
        found = whole.select("members")
        rows = keyed.where(F.col("n") > bucket)
        done = rows.isEmpty()
        if last and not done:  # what is still large meets block by block
            blocks = F.ceil(F.col("n") / F.lit(bucket)).cast("int")
            own = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(depth)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            pairs = own.groupBy("table", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
            found = found.unionByName(pairs.agg(F.collect_list("fp").alias("members")).select("members"))
        found = found.transform(shipped).mapInArrow(_forests, "u long, v long")
        out = found if out is None else out.unionByName(found)
        if done:
            break
        rows = rows.select("fp", "table")
    return out.distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, mark, fp and ``best``, the key and mark of its component's representative.

    The representative has the smallest key, nulls last, and of equal keys the smallest mark.
    """
    fps = materialize(fingerprints(docs, key, text))
    distinct = materialize(fps.groupBy("fp").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark")).alias("first")))
    joined = connected_components(links(distinct.select("fp")))
    parts = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    low = parts.groupBy("component").agg(F.min("first").alias("best"))
    return fps.join(parts.join(low, "component").select("fp", "best"), "fp").select("key", "mark", "fp", "best")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id (smallest key reachable).

    Texts without words (null, empty, blank) have fingerprint zero and link like others. Null keys are never
    the smallest; a component of null keys alone has a null id. Only key and text are read.
    """
    return classes(docs, key, text).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.key").alias("component_id"))


def told(key: Column, mark: Column) -> dict[str, Column]:
    """Columns that tell rows apart by key and text, without null-safe equality, so that a join reads the first shuffle."""
    return {"k": F.coalesce(key, F.lit(0)), "none": key.isNull(), "m": mark}


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: Callable[..., DataFrame] = classes) -> DataFrame:
    """``docs`` with one row for each component of near copies, as ``classes`` finds them, all its columns as they are.

    Rows that share a key are told apart by their texts, and rows without key are compared like others, so only
    copies go. Of rows equal in key and text any one stays; these are summed up before anything is shuffled.
    """
    columns, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    names = dict(zip(columns, inner, strict=True))
    gone = classes(docs, key, text).where(~(F.col("key").eqNullSafe(F.col("best.key")) & (F.col("mark") == F.col("best.mark"))))
    gone = gone.select(*(c.alias(n) for n, c in told(F.col("key"), F.col("mark")).items())).distinct()
    rows = docs.toDF(*inner).withColumns(told(F.col(names[key]).cast("long"), text_mark(names[text]))).dropDuplicates(["k", "none", "m"])
    kept = rows.join(gone, ["k", "none", "m"], "left_anti")
    return kept.select(*(F.col(i).alias(c) for c, i in names.items()))
