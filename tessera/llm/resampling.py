"""Importance resampling towards a target distribution over hashed word features.

Texts become packed streams of 16-bit bucket numbers with each document's place in them, written once. Counts come from
sorted runs: every stream is sorted and run-length encoded within its task, and runs of the same bucket are summed by a
shuffle. Gains per bucket (log ratios of the target's and the corpus's smoothed shares) are then gathered along the
streams and summed per document; documents are drawn by Gumbel noise from a hash of their key.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shipped

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Features of a stream row after which a new one begins; a longer document has a row of its own.
STREAM = 1 << 19
_BLOCK = "keys array<long>, words array<long>, ends array<long>, stream binary"


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z and all that isn't ASCII, A-Z lower-cased."""
    return WORD.findall(text.lower())  # lower() of bytes is of A-Z alone


def buckets_of(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words, shorter runs first."""
    hashes = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
    for k in range(2, longest + 1):
        hashes.append(np.fromiter((zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words) - k + 1)), np.uint32))
    return np.concatenate(hashes) % np.uint32(buckets)


def streams(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``rows`` (key long, text) as stream rows: keys, each document's words, where each ends, and the buckets as unsigned 16-bit numbers."""

    def pack(batches) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            data = np.concatenate(held).astype("<u2").tobytes() if held else b""
            return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["keys", "words", "ends", "stream"])

        keys, words, ends, held, size = [], [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words_of(text.as_py() or b"")
                b = buckets_of(found, longest, buckets)
                size += len(b)
                keys.append(key)
                words.append(len(found))
                ends.append(size)
                held.append(b)
                if size >= STREAM:
                    yield row()
                    keys, words, ends, held, size = [], [], [], [], 0
        if keys:
            yield row()

    return materialize(rows.transform(shipped).mapInArrow(pack, _BLOCK))


def counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket. A task sorts every stream and encodes its runs; the driver gets a row per bucket, of which there are 65,536 at most."""

    def runs(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                x = np.sort(np.frombuffer(data.as_py(), "<u2"), kind="stable")  # by radix for 16 bits
                starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
                total[x[starts]] += np.diff(np.concatenate((starts, [len(x)])))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    found = packed.select("stream").transform(shipped).mapInArrow(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the target's share of each bucket to the corpus's, one added to every count; floored."""
    size, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + size) / ((s + 1) * (all_t + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: int | None, seed: int) -> int:
    """1000 times Gumbel noise from a hash of the key, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(packed: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """Per document of the streams: key, words, n_features, weight (floored mean gain; 0 without features), score."""
    gain = gain.astype(np.int64)

    def gather(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, words, ends, data in zip(*batch.columns, strict=True):
                keys, ends = keys.as_py(), np.array(ends.as_py(), np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                n = ends - starts
                weight, some = np.zeros(len(n), np.int64), n > 0
                if some.any():
                    # documents without features lie between none, so those with some follow one another
                    weight[some] = np.add.reduceat(gain[np.frombuffer(data.as_py(), "<u2")], starts[some]) // n[some]
                score = weight + np.fromiter((noise(k, seed) for k in keys), np.int64, len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), words.values, pa.array(n), pa.array(weight), pa.array(score)], ["key", "words", "n_features", "weight", "score"])

    return packed.transform(shipped).mapInArrow(gather, "key long, words long, n_features long, weight long, score long")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``rank`` from 1 by falling score, then key: dealt by ranges, numbered within a range, ranges after one another.

    Rows equal in both are spread over ranges by their number in the table, so that no range holds more than its share.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = materialize(dealt.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row per range
    before = np.concatenate(([0], np.cumsum([n for _, n in sizes])))[: len(sizes)]
    offsets = rows.sparkSession.createDataFrame([(int(p), int(b)) for (p, _), b in zip(sizes, before, strict=True)], "part long, offset long")
    joined = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return joined.withColumn("rank", F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "offset", "place", "row")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, seed: int = 2024, at_least: int = 20, percent: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_features, weight, score, rank (null where it isn't drawn).

    Features are runs of 1 to ``longest`` words, hashed to ``buckets`` (65,536 at most, as they are stored in 16 bits).
    Of the documents with ``at_least`` words, ``percent`` of a hundred are drawn by highest score, ties to smaller keys.
    A null or empty text has no words and weight 0; a null key hashes as an empty one and comes last among ties; repeated
    rows count each time and get equal scores and ranks that follow one another; very long texts are read whole; an
    empty table gives an empty result, and an empty target one without counts. Of ``target`` only ``text`` is read.
    """
    if not 0 < buckets <= 1 << 16 or longest < 1:
        raise ValueError("1 to 65536 buckets, and runs of a word at least")
    texts = lambda df, k: df.select(k.cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    packed = streams(texts(docs, F.col(key)), longest, buckets)
    gain = gains(counts(packed, buckets), counts(streams(texts(target, F.lit(None)), longest, buckets), buckets))
    rows = materialize(scores(packed, gain, seed))
    # scores are whole numbers within some 60,000 of 0, so their counts are a bounded table
    able = F.col("words") >= at_least
    table = sorted(((r["score"], r["n"]) for r in rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    drawn, cut = sum(n for _, n in table) * percent // 100, None
    left = drawn
    for score, n in table:
        if left <= 0:
            break
        cut, left = score, left - n
    chosen = able & (F.col("score") >= cut) if cut is not None else F.lit(False)
    top = ranked(rows.where(chosen)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
