"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A document's key hashes to a place on the ring and belongs to the next virtual node clockwise. A shard
that is full passes what comes on to the next node with room. With ``epsilon`` 0 the bounds are exact
and row counts differ by one at most (law ``rows``); a larger one moves fewer rows.

Overflow is planned on counts per stretch of the ring, whose number is a parameter and not the data's;
rows then follow from their rank inside their stretch. Equal rows are summed first and a stretch is ranked in
salted parts, so no key, however often it is repeated and with however many texts, is a burden.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Ring places are 63-bit; the ring is cut at every virtual node and at 2**CELL_BITS even places.
PLACE_BITS, CELL_BITS = 63, 12
#: Rows of a stretch are ranked in so many parts, so that a key with many texts isn't ranked by one task.
SALTS = 32


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, in ring order."""
    return sorted((xxhash.xxh64_intdigest(f"shard-{s}-{v}") >> 1, s) for s in range(n_shards) for v in range(vnodes))


def _stretches(nodes: list[tuple[int, int]]) -> tuple[list[list[int]], list[int], list[int]]:
    """Cuts inside each even cell, the first stretch of each cell, and the owning node of each stretch."""
    width = 1 << (PLACE_BITS - CELL_BITS)
    places = [p for p, _ in nodes]
    cuts: list[list[int]] = [[] for _ in range(1 << CELL_BITS)]
    for p in places:
        cuts[p // width].append(p)
    first, owner = [], []
    for cell, inside in enumerate(cuts):
        first.append(len(owner))
        for low in [cell * width, *[p + 1 for p in inside]]:
            owner.append(bisect_left(places, low) % len(nodes))
    return cuts, first, owner


def capacities(total: int, n_shards: int, epsilon: float) -> list[int]:
    if epsilon == 0:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return [math.ceil((1 + epsilon) * total / n_shards)] * n_shards


def plan(counts: list[int], owner: list[int], nodes: list[tuple[int, int]], room: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """Per stretch, its segments (first rank, end rank, shard, slot of the first rank).

    Every stretch first fills its own shard in ring order; what is left walks clockwise to the next shard with room.
    """
    room, filled, out, left = list(room), [0] * len(room), [[] for _ in counts], []

    def put(k: int, at: int, shard: int, n: int) -> None:
        out[k].append((at, at + n, shard, filled[shard]))
        room[shard] -= n
        filled[shard] += n

    for k, n in enumerate(counts):
        shard = nodes[owner[k]][1]
        if take := min(n, room[shard]):
            put(k, 0, shard, take)
        if take < n:
            left.append((k, take))
    for k, at in left:
        node = owner[k]
        while at < counts[k]:
            node = (node + 1) % len(nodes)
            if take := min(counts[k] - at, room[nodes[node][1]]):
                put(k, at, nodes[node][1], take)
                at += take
    return out


def shard(docs: DataFrame, n_shards: int = 24, vnodes: int = 64, epsilon: float = 0.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard.

    A null text has no bytes; a null key has a place on the ring like any other. Equal rows (same key and
    text) are told apart by rank only. Only key and text are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    nodes = ring(n_shards, vnodes)
    cuts, first, owner = _stretches(nodes)
    width = 1 << (PLACE_BITS - CELL_BITS)
    cells = F.broadcast(spark.createDataFrame([(c, first[c], cuts[c]) for c in range(len(cuts))], "cell long, first int, cuts array<bigint>"))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64("key", F.lit("ring")), 1))
        rows = rows.withColumn("cell", F.expr(f"place div {width}")).join(cells, "cell")
        return rows.withColumn("stretch", F.col("first") + F.size(F.filter("cuts", lambda c: c < F.col("place")))).drop("cell", "first", "cuts")

    body = F.coalesce(F.col(text), F.lit(""))
    rows = placed(docs.select(F.col(key).alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("crc")))
    rows = materialize(rows.groupBy("stretch", "place", "key", "size", "crc").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("key", "size", "crc"), F.lit(SALTS)).cast("int")))
    parts = rows.groupBy("stretch", "salt").agg(F.sum("n").alias("m"))
    counts = [0] * len(owner)
    for row in parts.groupBy("stretch").agg(F.sum("m").alias("m")).collect():  # at most len(owner) rows
        counts[row["stretch"]] = row["m"]
    segments = plan(counts, owner, nodes, capacities(sum(counts), n_shards, epsilon))
    planned = F.broadcast(
        spark.createDataFrame([(k, s) for k, s in enumerate(segments) if s], "stretch int, segments array<struct<low:bigint,high:bigint,shard:int,slot:bigint>>")
    )

    earlier = Window.partitionBy("stretch").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("stretch", "salt", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))  # at most len(owner) * SALTS rows
    before = Window.partitionBy("stretch", "salt").orderBy("place", "key", "size", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("n").over(before)).join(F.broadcast(bases), ["stretch", "salt"])
    rows = rows.withColumn("high", F.col("base") + F.col("upto")).withColumn("low", F.col("high") - F.col("n")).join(planned, "stretch")

    def part(s: Column) -> Column:
        low = F.greatest(s["low"], F.col("low"))
        return F.struct(s["shard"].alias("shard"), (s["slot"] + low - s["low"]).alias("slot"), (F.least(s["high"], F.col("high")) - low).alias("n"))

    hit = F.filter("segments", lambda s: (s["low"] < F.col("high")) & (s["high"] > F.col("low")))
    rows = rows.withColumn("part", F.explode(F.transform(hit, part)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part.n") - 1)))
    return rows.select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows" if epsilon == 0 else "bounded").alias("law"),
        F.col("part.shard").alias("shard"),
        (F.col("part.slot") + F.col("copy")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
