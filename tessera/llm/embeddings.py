"""Near-duplicate vectors by sorted projection passes.

In each pass vectors get a key of concatenated random hashes (signs of random projections), are sorted by
it within their label, and each is compared with the next few; pairs found close are verified by cosine
and united across passes. Vectors near each other share long key prefixes in some pass with a probability
that the number of passes drives to one. A label has as many passes as its number of vectors needs.

A window is no cap on links: every pair inside a united group is then checked, in blocks, so a group of
any size gets its exact number of links however many of its members share a key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shipped
from tessera.llm.components import connected_components

#: PASSES at least; more where a label's vectors are so many that a pair at the threshold would be missed more often than MISS.
PASSES, WINDOW, KEY_BITS, MISS = 12, 24, 62, 1e-4
#: A group is checked in blocks of about so many different vectors.
BLOCK = 256


def planes(dim: int, turn: int, seed: int = 17) -> np.ndarray:
    """Random projections of one pass."""
    return np.random.default_rng([seed, dim, turn]).standard_normal((dim, KEY_BITS))


def passes_for(n: Column, least: int, window: int, threshold: float) -> Column:
    """How many passes ``n`` vectors of a label need.

    A bit of the key tells a pair at the threshold apart with probability acos(threshold) / pi. A pair that shares
    log2(n / window) bits has at most about ``window`` vectors between, where directions are spread evenly.
    """
    alike = math.log2(1 - math.acos(threshold) / math.pi)
    met = F.pow(F.greatest(n / F.lit(float(window)), F.lit(1.0)), F.lit(alike))
    return F.greatest(F.lit(least), F.when(met < 1, F.ceil(F.lit(math.log(MISS)) / F.log(1 - met))).otherwise(0)).cast("int")


def _matrix(column) -> list[np.ndarray]:
    """A batch's vectors (a list column) as unit rows of doubles."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy() - column.offsets[0].as_py()
    rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [r / np.linalg.norm(r) for r in rows]


def _keys(batches):
    known: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        rows, need = _matrix(batch.column("v")), batch.column("passes").to_numpy()
        dims = np.array([len(r) for r in rows])
        keys = np.zeros((len(rows), need.max(initial=0)), np.int64)
        for d in np.unique(dims):
            m = np.stack([rows[i] for i in np.flatnonzero(dims == d)])
            left = need[dims == d]
            for turn in range(left.max()):
                if (int(d), turn) not in known:
                    known[int(d), turn] = planes(int(d), turn)
                bits = m[left > turn] @ known[int(d), turn] > 0
                keys[np.flatnonzero((dims == d) & (need > turn)), turn] = bits.astype(np.int64) @ (np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))
        flat = pa.array(keys[np.arange(keys.shape[1]) < need[:, None]])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *need]), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("g"), batch.column("d"), batch.column("v"), lists], ["node", "g", "d", "x", "keys"])


def _types(x: str) -> tuple[pa.Schema, pa.Schema, str]:
    """Schemas of a partition's border rows and of what a pass finds, for vectors of ``x`` (float or double)."""
    number = pa.float32() if x == "float" else pa.float64()
    edge = [("node", pa.int64()), ("g", pa.string()), ("d", pa.int32()), ("x", pa.list_(number)), ("p", pa.int32()), ("key", pa.int64()), ("pos", pa.int64())]
    return pa.schema(edge), pa.schema([("u", pa.int64()), ("v", pa.int64()), *edge]), f"u long, v long, node long, g string, d int, x array<{x}>, p int, key long, pos long"


def _found(rows: dict, schema: pa.Schema) -> list[pa.RecordBatch]:
    n = len(next(iter(rows.values())))
    return pa.table([rows[f.name].cast(f.type) if f.name in rows else pa.nulls(n, f.type) for f in schema], schema=schema).combine_chunks().to_batches()


def _windows(batches, window: int, threshold: float, x: str):
    """Links of close neighbours among rows sorted by (p, g, d, key), one partition at a time.

    The last ``window`` rows are carried over, so a partition is read as a stream. Its first and last ``window``
    rows follow at the end, with their position, to be compared across partitions.
    """
    border, found, _ = _types(x)
    tail: tuple | None = None
    first, last, seen = [], None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).select(border.names[:-1]).append_column("pos", pa.array(np.arange(seen, seen + batch.num_rows)))
        if seen < window:
            first.append(table.slice(0, window - seen))
        last = table if last is None else pa.concat_tables([last, table])
        last, seen = last.slice(max(0, last.num_rows - window)), seen + batch.num_rows
        node = batch.column("node").to_numpy()
        group = list(zip(*(batch.column(c).to_pylist() for c in ("p", "g", "d")), strict=True))
        rows = _matrix(batch.column("x"))
        fresh = 0
        if tail:
            fresh = len(tail[0])
            node, group, rows = np.concatenate([tail[0], node]), tail[1] + group, tail[2] + rows
        starts = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
        us, vs = [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a < 2:
                continue
            m = np.stack(rows[a:b])
            for step in range(1, min(window, b - a - 1) + 1):
                close = np.flatnonzero(np.einsum("ij,ij->i", m[:-step], m[step:]) >= threshold)
                close = close[close + step + a >= fresh]
                us.append(node[a + close])
                vs.append(node[a + close + step])
        if us:
            yield from _found({"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs))}, found)
        tail = (node[-window:], group[-window:], rows[-window:])
    if seen:
        edge = pa.concat_tables([*first, last.slice(max(0, window - last.column("pos")[0].as_py()))])
        yield from _found({c: edge.column(c).combine_chunks() for c in border.names}, found)


def near_pairs(nodes: DataFrame, passes: int = PASSES, window: int = WINDOW, threshold: float = 0.93) -> DataFrame:
    """Verified links ``u``, ``v`` from the sorted passes over ``nodes`` (node, g, d, v), ``passes`` of them or more."""
    x = nodes.schema["v"].dataType.elementType.simpleString()
    found_sql = _types(x)[2]
    counts = materialize(nodes.groupBy("g", "d").agg(passes_for(F.count("*"), passes, window, threshold).alias("passes")))
    keyed = nodes.join(counts, ["g", "d"]).transform(shipped).mapInArrow(_keys, f"node long, g string, d int, x array<{x}>, keys array<bigint>")
    each = keyed.select("node", "g", "d", "x", F.posexplode("keys").alias("p", "key"))
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = each.repartitionByRange(n, "p", "g", "d", "key").sortWithinPartitions("p", "g", "d", "key")
    found = materialize(dealt.transform(shipped).mapInArrow(lambda b: _windows(b, window, threshold, x), found_sql))
    # The rows beside the borders of all partitions: at most 2 * n * window, in the order of the pass.
    edges = found.where("u is null").drop("u", "v").repartition(1).sortWithinPartitions("p", "g", "d", "key", "pos")
    across = edges.transform(shipped).mapInArrow(lambda b: _windows(b, window, threshold, x), found_sql).where("u is not null")
    return found.where("u is not null").select("u", "v").unionByName(across.select("u", "v")).distinct()


def _count_links(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Links between the vectors of two blocks of a group, or inside one, counted on both sides."""
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, block, times = (table.column(c).to_numpy() for c in ("node", "block", "times"))
        m = np.stack(_matrix(table.column("v").combine_chunks()))
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(a) or not len(b):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        near = m[a] @ m[b].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            found = [(node[a], near @ times[b])]
        else:
            found = [(node[a], near @ times[b]), (node[b], times[a] @ near)]
        return pa.table({"node": pa.array(np.concatenate([x for x, _ in found])), "links": pa.array(np.concatenate([y for _, y in found]).astype(np.int64))})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, passes: int = PASSES, window: int = WINDOW, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Vectors that are null, zero or empty, hold a null or non-finite component, or have no label or key link with
    nothing and are kept; only vectors of one length are compared, in the precision that they have. Equal vectors of a
    label are one node with their number. A key that repeats names a vector on each of its rows, each with the links
    and component of its own. Only key, vector and label are read.
    """
    v, element = F.col("v"), vectors.schema[vector].dataType.elementType.simpleString()
    good = F.col("g").isNotNull() & F.col("k").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fine = good & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    given = F.col(vector).cast("array<float>" if element == "float" else "array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("k"), given.alias("v"), F.col(label).cast("string").alias("g")).withColumn("fine", fine)
    some = rows.where("fine").select("k", "v", "g")
    nodes = some.groupBy("g", "v").agg(F.min("k").alias("low"), F.count("*").alias("times"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("d", F.size("v")))
    parts = materialize(connected_components(near_pairs(nodes.select("node", "g", "d", "v"), passes, window, threshold)))
    least = parts.join(nodes.select("node", "low"), "node").groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.min("low").alias("low"))
    sizes = materialize(least)
    member = nodes.drop("low").join(parts, "node").join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("component", "d", "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "times", "v")
    counted = pairs.transform(shipped).groupBy("component", "g", "d", "i", "j").applyInArrow(_count_links(threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    named = parts.join(sizes.select("component", F.col("low").alias("first")), "component").select("node", "first")
    known = nodes.join(named, "node", "left").join(counted, "node", "left").select("g", "v", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("first", "low").alias("component_id"))
    linked = some.join(known, ["g", "v"]).select("k", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    return linked.unionByName(alone).select(F.col("k").alias(key), "n_links", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


def brute_force(spark: SparkSession, vectors: DataFrame, threshold: float = 0.93) -> set[tuple[int, int]]:
    """All linked pairs of a small table, for tests."""
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.select("vec_id", "embedding", "label").collect()]
    out = set()
    for i, (a, x, l) in enumerate(rows):
        for b, y, m in rows[i + 1 :]:
            if l is None or l != m or not x or not y or None in x or None in y:
                continue
            p, q = np.array(x, float), np.array(y, float)
            if np.isfinite(p).all() and np.isfinite(q).all() and p.any() and q.any() and len(p) == len(q) and p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= threshold:
                out.add((min(a, b), max(a, b)))
    return out
