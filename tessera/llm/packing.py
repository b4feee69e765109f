"""Packing token pieces into sequences by best-two-fit.

Sequences are filled greedily, each time with the longest piece that fits. Then a sequence's shortest
piece is replaced by two unpacked pieces if together they fill the widened gap more tightly.

Lengths are at most the sequence's, so the whole packing is decided on a histogram of lengths: equal
fillings are decided once and repeated as often as the counts allow. What the driver holds is bounded by
the sequence length, not by the data. Pieces then find their place by their rank among equal lengths.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shipped
from tessera.llm.tok import encoder

#: Pieces of one length are ranked in so many parts at least, and in more where a part would have more than PART pieces.
SALTS, PART = 32, 1 << 20


@dataclass
class Plan:
    """Segments sorted by (length, first rank): pieces of that length from that rank on go to sequences from
    ``sequence`` on, one each, at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int


def fill(counts: dict[int, int], lengths: list[int], capacity: int) -> list[int]:
    """One sequence's pieces, longest first, from the sorted ``lengths`` that ``counts`` still has."""
    used: dict[int, int] = {}
    bin_: list[int] = []
    gap = capacity

    def largest(most: int) -> int:
        at = bisect_right(lengths, most) - 1
        while at >= 0 and used.get(lengths[at], 0) >= counts[lengths[at]]:
            at -= 1
        return lengths[at] if at >= 0 else 0

    while gap and (n := largest(gap)):
        take = min(gap // n, counts[n] - used.get(n, 0))
        bin_ += [n] * take
        used[n] = used.get(n, 0) + take
        gap -= n * take
    if gap and len(bin_) > 1:
        small = bin_[-1]
        room, best = gap + small, (small, 0, 0)
        at = bisect_right(lengths, room) - 1
        while at >= 0 and 2 * lengths[at] > best[0]:
            a = lengths[at]
            at -= 1
            if used.get(a, 0) >= counts[a]:
                continue
            used[a] = used.get(a, 0) + 1
            b = largest(min(a, room - a))
            used[a] -= 1
            if b and a + b > best[0]:
                best = (a + b, a, b)
                if best[0] == room:
                    break
        if best[1]:
            bin_ = sorted([*bin_[:-1], best[1], best[2]], reverse=True)
    return bin_


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Pack all pieces of the histogram {length: pieces}."""
    counts = {n: c for n, c in histogram.items() if c}
    lengths: list[int] = []
    for n in counts:
        insort(lengths, n)
    done, segments, sequence = dict.fromkeys(counts, 0), [], 0
    while lengths:
        bin_ = fill(counts, lengths, capacity)
        need: dict[int, int] = {}
        for n in bin_:
            need[n] = need.get(n, 0) + 1
        times = min(counts[n] // k for n, k in need.items())
        offset = 0
        for n in bin_:
            segments.append((n, done[n], sequence, offset))
            done[n] += times
            offset += n
        for n, k in need.items():
            counts[n] -= k * times
            if not counts[n]:
                lengths.remove(n)
        sequence += times
    s = np.array(sorted(segments), np.int64).reshape(-1, 4)
    return Plan(s[:, 0], s[:, 1], s[:, 2], s[:, 3], sequence)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str, text: str) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32 and salt."""

    def cut(batches):
        enc = encoder(tokenizer)
        end, step = end_id.to_bytes(enc.width, "little"), capacity * enc.width
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(t.as_py()) + end
                for i, a in enumerate(range(0, len(ids), step)):
                    part = np.frombuffer(ids[a : a + step], f"<u{enc.width}").astype("<u4").tobytes()
                    for c, x in zip(cols, (k, i, i * capacity, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.transform(shipped).mapInArrow(cut, "key long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Only longer documents are cut. Null keys and repeated rows are
    packed like others; only key and text are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, key, text))
    sizes = cut.groupBy("length").agg(F.greatest(F.lit(SALTS), F.ceil(F.count("*") / F.lit(PART))).cast("int").alias("salts"))  # at most capacity rows
    salted = cut.join(F.broadcast(materialize(sizes)), "length").withColumn("salt", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.col("salts")).cast("int"))
    counts = salted.groupBy("length", "salt").count().collect()  # at most capacity * SALTS rows, and one for every PART pieces
    histogram: dict[int, int] = {}
    base = {}
    for length, salt, n in sorted((r["length"], r["salt"], r["count"]) for r in counts):
        base[length, salt] = histogram.get(length, 0)
        histogram[length] = histogram.get(length, 0) + n
    keys = np.array(sorted(base), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((plan(histogram, capacity), keys[:, 0] << 32 | keys[:, 1], np.array([base[tuple(k)] for k in keys.tolist()], np.int64)))

    def place(batches):
        p, salts, bases = shared.value
        order = p.length << 44 | p.rank
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, salt, rank = (t.column(c).to_numpy() for c in ("length", "salt", "rank"))
            rank = rank - 1 + (bases[np.searchsorted(salts, length << 32 | salt)] if len(salts) else 0)
            at = np.searchsorted(order, length << 44 | rank, "right") - 1
            cols = [t.column(c).combine_chunks() for c in ("key", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p.sequence[at] + rank - p.rank[at]), pa.array(p.offset[at])], ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "piece", "ids_crc32")).cast("long"))
    out = ranked.transform(shipped).mapInArrow(place, "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)
