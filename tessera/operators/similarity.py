"""Similarities of teacher and student nodes inside a group (case_id, student, node_type).

Nodes come as a table with the group, ``side`` (t or s), ``pos``, ``node_id`` and ``match_text``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.functions.tables import large, materialize, ship, small_batches
from tessera.operators import blocks

GROUP = ["case_id", "student", "node_type"]
NODE = [*GROUP, "side", "pos"]
#: Nodes of one side that meet those of the other in one place.
BLOCK = 512
#: Blocks that meet in one task where texts are equal: some 4 million pairs.
TILES = 16
#: A block of texts has so many of them, or so many bytes; groups of up to SMALL texts and so many bytes are kept in one row.
TEXTS, TEXT_BYTES, SMALL, SMALL_BYTES = 4096, 8 << 20, 256, 1 << 20


def _met(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``rows`` (with ``n_t`` and ``n_s``, how many of each side share a group or term), dealt into blocks ``i`` of
    the teacher's and ``j`` of the student's, so that each pair meets once and no key, however common, meets in one place."""

    def parts(side: str) -> Column:
        return F.ceil(F.col(f"n_{side}") / F.lit(BLOCK)).cast("int")

    def dealt(side: str, own: str, other: str) -> DataFrame:
        out = rows.where((F.col("side") == side) & (F.col(f"n_{'s' if side == 't' else 't'}") > 0))
        out = out.withColumn(own, F.when(parts(side) == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("pos"), parts(side)).cast("int")))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0), parts("s" if side == "t" else "t") - 1)))

    return dealt("t", "i", "j"), dealt("s", "j", "i")


def _sides() -> list[Column]:
    return [F.count_if(F.col("side") == s).alias(f"n_{s}") for s in "ts"]


def _found(schema: dict[str, pa.DataType], group: list, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*group, *columns], schema.values(), strict=True)], list(schema))


_PAIRS = {**dict.fromkeys(GROUP, pa.string()), "t_pos": pa.int32(), "s_pos": pa.int32(), "similarity": pa.float64()}
_PAIRS_DDL = "case_id string, student string, node_type string, t_pos int, s_pos int, similarity double"
_BLOCK = {**dict.fromkeys(GROUP, pa.string()), "side": pa.string(), "block": pa.int32(), "n": pa.int64(), "b_t": pa.int32(), "b_s": pa.int32()}
_BLOCK_DDL = "case_id string, student string, node_type string, side string, block int, n long, b_t int, b_s int"
#: A block of weighed terms: of each text ``pos``, ``norm`` and where its terms end; of a text's term which of ``terms`` it is and how often it comes.
_PARTS = {"pos": pa.int32(), "norm": pa.float64(), "ends": pa.int32(), "at": pa.int32(), "tf": pa.int32(), "terms": pa.int64(), "idf": pa.float64()}
_MATRIX = {**_BLOCK, **{c: pa.list_(t) for c, t in _PARTS.items()}}
_MATRIX_DDL = _BLOCK_DDL + ", pos array<int>, norm array<double>, ends array<int>, at array<int>, tf array<int>, terms array<long>, idf array<double>"


def _small(nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of groups that are one row each, many groups at once."""
    rows = nodes.groupBy(*GROUP).agg(F.collect_list(F.struct("side", "pos", "match_text")).alias("x"))
    rows = rows.select(*GROUP, F.transform("x", lambda x: x["side"] == "t").alias("teacher"), F.transform("x", lambda x: x["pos"].cast("int")).alias("pos"), F.transform("x", lambda x: X.tokens(x["match_text"])).alias("words"))

    def run(batches):
        for batch in batches:
            for g, t, s, sim in blocks.small_groups(batch, threshold):
                yield _found(_PAIRS, [batch.column(c).take(pa.array(g)) for c in GROUP], t, s, sim)

    return rows.mapInArrow(run, _PAIRS_DDL)


def _weighed(nodes: DataFrame) -> DataFrame:
    """Groups that are dealt into blocks (``b_t``, ``b_s`` of them): a block is one row, a sparse matrix of its terms, with their
    idf and the norms of its texts.

    Each of as many ranges of terms as a group has blocks adds up how many texts have a term. No term is a row by itself.
    Terms that only one side has stay in the norms and aren't kept, so what meets other blocks is small.
    """
    own = [*GROUP, "side", "block"]
    size = F.when(F.col("side") == "t", F.col("b_t")).otherwise(F.col("b_s"))
    dealt = nodes.select(*NODE, "match_text", "times", "n", "b_t", "b_s", F.pmod(F.xxhash64("pos"), size).cast("int").alias("block")).repartition(*own)
    lists = {"pos": pa.int32(), "ends": pa.int32(), "at": pa.int32(), "tf": pa.int32(), "terms": pa.int64(), "df": pa.int32()}
    schema = {**_BLOCK, **{c: pa.list_(t) for c, t in lists.items()}}

    def matrix(rows: pa.Table) -> pa.Table:
        x = blocks.block(rows)
        return pa.Table.from_batches([_found(schema, [rows.column(c).slice(0, 1).combine_chunks() for c in _BLOCK], *([x[c]] for c in lists))])

    worded = dealt.select(*own, "n", "b_t", "b_s", F.col("pos").cast("int").alias("pos"), "times", X.tokens(F.col("match_text")).alias("words"))
    made = materialize(worded.groupBy(*own).applyInArrow(matrix, _BLOCK_DDL + ", pos array<int>, ends array<int>, at array<int>, tf array<int>, terms array<long>, df array<int>"), rows=1)
    piece = {**_BLOCK, "part": pa.int32(), "terms": pa.list_(pa.int64()), "df": pa.list_(pa.int32())}

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                terms, df = (row.column(c).flatten().to_numpy() for c in ("terms", "df"))
                parts = row.column("b_t")[0].as_py() + row.column("b_s")[0].as_py()
                at = blocks.cut_terms(terms, parts)
                head = [pa.array([row.column(c)[0].as_py()] * parts, t) for c, t in _BLOCK.items()]
                yield _found(piece, head, np.arange(parts), *([x[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] for x in (terms, df)))

    total = {**_BLOCK, "part": pa.int32(), "n_t": pa.list_(pa.int32()), "n_s": pa.list_(pa.int32())}

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        terms, df = ([x.values.to_numpy() for x in rows.column(c)] for c in ("terms", "df"))
        sums = blocks.totals(np.array(rows.column("side").to_pylist()) == "t", terms, df)
        head = [rows.column(c).combine_chunks() for c in [*_BLOCK, "part"]]
        return pa.Table.from_batches([_found(total, head, *([x[k] for x in sums] for k in (0, 1)))])

    pieces = made.select(*_BLOCK, "terms", "df").mapInArrow(cut, _BLOCK_DDL + ", part int, terms array<long>, df array<int>")
    counts = pieces.groupBy(*GROUP, "part").applyInArrow(add, _BLOCK_DDL + ", part int, n_t array<int>, n_s array<int>")

    def weigh(rows: pa.Table, sums: pa.Table) -> pa.Table:
        order = np.argsort(sums.column("part").to_numpy(), kind="stable")
        n_t, n_s = (np.concatenate([sums.column(c)[int(k)].values.to_numpy() for k in order]) for c in ("n_t", "n_s"))
        x = blocks.weighed({c: rows.column(c)[0].values.to_numpy() for c in lists if c != "df"}, rows.column("n")[0].as_py(), n_t, n_s)
        return pa.Table.from_batches([_found(_MATRIX, [rows.column(c).combine_chunks() for c in _BLOCK], *([x[c]] for c in _PARTS))])

    return materialize(made.drop("df").groupBy(*own).cogroup(counts.groupBy(*own)).applyInArrow(weigh, _MATRIX_DDL), rows=1)


def _meet(made: DataFrame, find, ddl: str) -> DataFrame:
    """``find(group, teachers, students)`` for each block of teachers with each of students (dicts of arrays, and ``blocks``, how many the
    side has); it yields record batches of ``ddl``'s columns."""
    out = None
    for side, mine, other in (("t", "i", "j"), ("s", "j", "i")):
        copies = made.where((F.col("side") == side) & (F.col("b_t") > 0) & (F.col("b_s") > 0)).withColumn(mine, F.col("block"))
        copies = copies.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("b_s" if side == "t" else "b_t") - 1)))
        out = copies if out is None else out.unionByName(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, group = {}, None
        for batch in batches:
            for k, side in enumerate(batch.column("side").to_pylist()):
                both[side] = {c: batch.column(c)[k].values.to_numpy() for c in _PARTS} | {"blocks": batch.column(f"b_{side}")[k].as_py()}
                group = [batch.column(c)[k].as_py() for c in GROUP]
        if len(both) == 2:
            yield from find(group, both["t"], both["s"])

    return out.groupBy(*GROUP, "i", "j").applyInArrow(run, ddl)


def block_pairs(made: DataFrame, threshold: float) -> DataFrame:
    """All pairs with at least ``threshold`` of blocks as :func:`term_blocks` gives them, strip by strip."""

    def find(group, t, s):
        for i, j, sim in blocks.tile(t, s, threshold):
            yield _found(_PAIRS, [pa.repeat(pa.scalar(g, pa.string()), len(i)) for g in group], t["pos"][i], s["pos"][j], sim)

    pairs = _meet(made, find, _PAIRS_DDL).withColumn("similarity", F.round("similarity", 12))
    return pairs.where(F.col("similarity") >= F.lit(threshold))


_NEAR = {**dict.fromkeys(GROUP, pa.string()), **{c: pa.list_(t) for c, t in (("t_kind", pa.int32()), ("s_kind", pa.int32()), ("similarity", pa.float64()), ("t", pa.int32()), ("t_bound", pa.float64()), ("s", pa.int32()), ("s_bound", pa.float64()))}}
_NEAR_DDL = "case_id string, student string, node_type string, t_kind array<int>, s_kind array<int>, similarity array<double>, t array<int>, t_bound array<double>, s array<int>, s_bound array<double>"


def nearest(made: DataFrame, threshold: float, most: int) -> DataFrame:
    """One row for each two blocks that meet: pairs (t_kind, s_kind, similarity, not rounded yet) that are among the best of one of
    their ends there (``most`` over all blocks, at least 2 in each), ties included, and each end (``t``, ``s``) with the similarity from which on all its pairs are listed (``-inf``: all)."""

    def find(group, t, s):
        shares = (max(2, -(-most // x["blocks"])) for x in (s, t))  # of all that a node meets in its group
        i, j, sim, t_bound, s_bound = blocks.nearest(t, s, threshold, *shares)
        yield _found(_NEAR, [[g] for g in group], [t["pos"][i]], [s["pos"][j]], [sim], [t["pos"]], [t_bound], [s["pos"]], [s_bound])

    return _meet(made, find, _NEAR_DDL)


def kept_in(made: DataFrame, left: DataFrame) -> DataFrame:
    """The blocks with the texts of ``left`` (group, side, pos) alone; weights stay those of the whole group."""
    own = [*GROUP, "side", "block"]
    places = made.select(*own, F.explode("pos").alias("pos")).join(left, [*GROUP, "side", "pos"], "left_semi")
    stay = places.groupBy(*own).agg(F.collect_list("pos").alias("stay"))

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x = blocks.only({c: batch.column(c)[k].values.to_numpy() for c in _PARTS}, batch.column("stay")[k].values.to_numpy())
                yield _found(_MATRIX, [batch.column(c).slice(k, 1) for c in _BLOCK], *([x[c]] for c in _PARTS))

    return materialize(made.join(large(stay), own).mapInArrow(cut, _MATRIX_DDL), rows=1)


def _sized(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(groups with both sides, their sizes and numbers of blocks; their nodes with that)."""
    if threshold <= 0:
        raise ValueError("terms that texts share need a threshold above 0")
    ship(nodes.sparkSession)
    small_batches(nodes.sparkSession)
    alike = "times" in nodes.columns
    nodes = nodes if alike else nodes.withColumn("times", F.lit(1).cast("long"))
    size = F.octet_length(F.coalesce("match_text", F.lit("")))
    sides = [F.sum(F.when(F.col("side") == s, size).otherwise(0)).alias(f"bytes_{s}") for s in "ts"]
    n = nodes.groupBy(*GROUP).agg(F.sum("times").alias("n"), F.count_if(F.lower("match_text").rlike(X.TOKEN)).alias("with_terms"), *_sides(), *sides)
    parts = [F.when(F.col(f"n_{s}") > 0, F.ceil(F.greatest(F.col(f"n_{s}") / F.lit(TEXTS), F.col(f"bytes_{s}") / F.lit(TEXT_BYTES)))).otherwise(0).cast("int").alias(f"b_{s}") for s in "ts"]
    small = (F.lit(not alike) & (F.col("n") <= SMALL) & (F.col("bytes_t") + F.col("bytes_s") <= SMALL_BYTES)).alias("small")
    n = materialize(n.select(*GROUP, "n", "with_terms", "n_t", "n_s", small, *parts)).where("n_t > 0 and n_s > 0")
    return n, nodes.select(*NODE, "match_text", "times").join(n, GROUP)


def term_blocks(nodes: DataFrame, threshold: float) -> DataFrame:
    """Nodes with ``times`` (see :func:`tfidf_pairs`) whose groups have terms, as blocks of weighed terms."""
    return _weighed(_sized(nodes, threshold)[1].where("with_terms > 0"))


def tfidf_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs with cosine >= threshold (> 0) of TF-IDF vectors over words and word pairs.

    idf = ln((1 + n) / (1 + df)) + 1 over the texts of the group, both sides, empty ones too. Groups of up to SMALL texts are
    one row each and are worked out where they are; larger ones are dealt into blocks. A group in which no text has a term
    falls back to equality of trimmed lower-case texts.

    A column ``times`` says how many texts of the group a row stands for; then every group is dealt into blocks.
    """
    n, told = _sized(nodes, threshold)
    found = _small(told.where("with_terms > 0 and small"), threshold).withColumn("similarity", F.round("similarity", 12))
    if not n.where("with_terms > 0 and not small").isEmpty():
        found = found.unionByName(block_pairs(_weighed(told.where("with_terms > 0 and not small")), threshold))
    if not n.where("with_terms = 0").isEmpty():
        key = [*GROUP, "text"]
        plain, sizes = _plain(told)
        tiles = sizes.agg(F.sum(F.ceil(F.col("n_t") / F.lit(BLOCK)) * F.ceil(F.col("n_s") / F.lit(BLOCK)))).first()[0] or 0
        parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-int(tiles) // TILES))
        t, s = (x.repartition(parts, *key, "i", "j") for x in _met(plain.join(sizes, key)))  # a given number, so that few rows with many pairs aren't put into few tasks
        same = t.select(*key, "i", "j", F.col("pos").cast("int").alias("t_pos")).join(s.select(*key, "i", "j", F.col("pos").cast("int").alias("s_pos")), [*key, "i", "j"])
        found = found.unionByName(same.select(*GROUP, "t_pos", "s_pos", F.lit(1.0).alias("similarity")))
    return found.where(F.col("similarity") >= F.lit(threshold))


def _plain(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of groups without any term by their whole ``text``, and how many of each side have a text."""
    plain = told.where("with_terms = 0").drop("n_t", "n_s").withColumn("text", F.lower(F.trim("match_text"))).where("text <> ''")
    return plain, plain.groupBy(*GROUP, "text").agg(*_sides())


_LEVELS = {**dict.fromkeys(GROUP, pa.string()), "side": pa.string(), "pos": pa.int32(), "best": pa.float64(), "pairs": pa.list_(pa.int64())}
_LEVELS_DDL = "case_id string, student string, node_type string, side string, pos int, best double, pairs array<long>"


def tfidf_levels(nodes: DataFrame, levels: Sequence[float]) -> DataFrame:
    """What :func:`tfidf_pairs` would give at each of ``levels``, counted where blocks meet, so that no pair of a large group is a row.

    One or more rows per node with a pair: group, side, pos, ``best`` similarity, and for teachers ``pairs`` (one number per level).
    """
    least = min(levels)
    n, told = _sized(nodes, least)

    def find(group, t, s):
        for side, pos, best, pairs in blocks.levels(t, s, levels):
            head = [pa.repeat(pa.scalar(g, pa.string()), len(pos)) for g in (*group, side)]
            yield _found(_LEVELS, head, pos, best, list(pairs))

    few = _small(told.where("with_terms > 0 and small"), least).withColumn("similarity", F.round("similarity", 12)).where(F.col("similarity") >= F.lit(least))
    one = F.array(*((F.col("similarity") >= F.lit(float(x))).cast("long") for x in levels))
    none = F.array(*(F.lit(0).cast("long") for _ in levels))
    out = few.select(*GROUP, F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_pos").alias("pos"), F.col("similarity").alias("best"), (one if s == "t" else none).alias("pairs")) for s in "ts"))).alias("x")).select(*GROUP, "x.*")
    if not n.where("with_terms > 0 and not small").isEmpty():
        out = out.unionByName(_meet(_weighed(told.where("with_terms > 0 and not small")), find, _LEVELS_DDL))
    if not n.where("with_terms = 0").isEmpty():
        plain, sizes = _plain(told)
        met = plain.join(sizes.where("n_t > 0 and n_s > 0"), [*GROUP, "text"])
        every = F.array(*((F.lit(1.0) >= F.lit(float(x))).cast("long") * F.when(F.col("side") == "t", F.col("n_s")).otherwise(0) for x in levels))
        out = out.unionByName(met.where(F.lit(1.0) >= F.lit(least)).select(*GROUP, "side", F.col("pos").cast("int").alias("pos"), F.lit(1.0).alias("best"), every.alias("pairs")))
    return out


def embedding_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs with cosine >= threshold of given vectors (column ``vector``); nodes without one are an error.

    Vectors are scaled to unit length once; a group's sides meet block by block, and two blocks are one product of matrices.
    """
    v = F.transform("vector", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    checked = F.when(F.col("vector").isNull(), F.raise_error(F.lit("a node has no vector"))).otherwise(F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))
    unit = materialize(nodes.select(*NODE, checked.alias("u")))
    t, s = _met(unit.join(unit.groupBy(*GROUP).agg(*_sides()), GROUP))
    ship(nodes.sparkSession)
    small_batches(nodes.sparkSession)

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.schema(list(_PAIRS.items())).empty_table()
        x, y = ([v.values.to_numpy() for v in side.column(c)] for side, c in ((a, "t_u"), (b, "s_u")))
        width = max(map(len, x + y))
        left, right = (np.stack([np.pad(v, (0, width - len(v))) for v in side]) for side in (x, y))
        dots = left @ right.T
        i, j = np.nonzero(dots >= threshold - blocks.SLACK)
        group = [pa.array([a.column(f"t_{c}")[0].as_py()] * len(i), pa.string()) for c in GROUP]
        return pa.Table.from_batches([_found(_PAIRS, group, a.column("t_pos").to_numpy()[i], b.column("s_pos").to_numpy()[j], dots[i, j])])

    def met(rows: DataFrame, side: str):
        keys = [*GROUP, "i", "j"]
        named = rows.select(*(F.col(c).alias(f"{side}_{c}") for c in keys), F.col("pos").cast("int").alias(f"{side}_pos"), F.col("u").alias(f"{side}_u"))
        return named.groupBy(*(f"{side}_{c}" for c in keys))

    found = met(t, "t").cogroup(met(s, "s")).applyInArrow(multiply, _PAIRS_DDL)
    return found.withColumn("similarity", F.round("similarity", 12)).where(F.col("similarity") >= F.lit(threshold))
