"""Phrase collocations by levels: candidates whose parts are frequent, counted in the slots of a minimal perfect hash.

Texts become streams of word numbers, with a break wherever a phrase can't go on: at a piece's end, at an infrequent word.
On each level a phrase is the pair (slot of the phrase without its last word, number of that word), so keys are exact 64-bit
numbers. A phrase is looked at only where the phrases without its last and without its first word are both frequent
(Apriori). Mappers first count such phrases in a sieve of hashed cells, whose sums rule out most; what remains are the
candidates. These get a minimal perfect hash with their keys stored by slot; mappers count slots with ``np.bincount`` and the
arrays are summed as a tree of shuffles. The stream then goes on with the frequent phrases alone.

At most n / min_count phrases of each length are frequent, where n is the number of words; all that is held at once follows
from that, not from the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shipped
from tessera.llm.tokenbin import PerfectHash, _mix

#: A byte that no UTF-8 text holds; it stands for the end of a piece.
BREAK = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)
#: Words of a stream row; keys looked at together; distinct words held by a mapper.
BLOCK, KEYS, HELD = 1 << 17, 1 << 18, 1 << 18
#: Candidates counted in one pass, and frequent words encoded in one; more take further passes.
SLOTS, VOCABULARY = 1 << 22, 1 << 20
#: Cells of a sieve for each phrase that can be frequent, and the most cells there are.
CELLS, MOST_CELLS = 2, 1 << 24
#: Counts that go through a shuffle together; mappers for each core, and sums in the tree's first row.
CHUNK, MAPPERS, FAN = 1 << 15, 2, 16
#: Frequent phrases of one length that workers hold at once (12 bytes each and their hash).
FREQUENT = 1 << 26
_STREAM = "slots binary, words binary"


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased, and a break between pieces."""
    return (text or b"").translate(_TABLE).replace(BREAK, b" \xff ").split()


# --- words -----------------------------------------------------------------------------------------------------------


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of ``rows`` (lang, text as bytes), and per language a row without word for all of them."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def drain() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                c.pop(BREAK, None)
                words = [*c, None]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words, pa.binary()), pa.array([*c.values(), c.total()], pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, Counter()).update(tokens_of(text.as_py()))
            if sum(map(len, held.values())) > HELD:
                yield from drain()
        yield from drain()

    return rows.transform(shipped).mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def encode(rows: DataFrame, vocabulary: list[pa.Table]) -> DataFrame:
    """``rows`` as streams of word numbers, -1 for breaks and infrequent words. The words come in parts of bounded size; each takes
    one pass, and only between passes do texts stay beside their numbers."""
    spark, out = rows.sparkSession, rows.withColumn("slots", F.lit(None).cast("binary"))
    for i, part in enumerate(vocabulary):
        held, last = spark.sparkContext.broadcast(part), i + 1 == len(vocabulary)

        def number(batches, held=held, last=last) -> Iterator[pa.RecordBatch]:
            class Numbers(dict):
                def __missing__(self, word: bytes) -> int:
                    return -1

            by: dict[str, Numbers] = {}
            for lang, word, k in zip(*(c.to_pylist() for c in held.value.columns), strict=True):
                by.setdefault(lang, Numbers())[word] = k
            none, got, size = Numbers(), [], 0

            def row() -> pa.RecordBatch:
                data = pack(np.concatenate(got), None)
                return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], ["slots", "words"])

            for batch in batches:
                filled = []
                for lang, text, before in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    toks = tokens_of(text.as_py())
                    toks.append(BREAK)
                    ids = np.fromiter(map(by.get(lang, none).__getitem__, toks), np.int32, len(toks))
                    if before.is_valid:
                        ids = np.maximum(ids, np.frombuffer(before.as_py(), "<i4"))
                    if not last:
                        filled.append(ids.astype("<i4").tobytes())
                        continue
                    got.append(ids)
                    size += len(ids)
                    if size >= BLOCK:
                        yield row()
                        got, size = [], 0
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(filled, pa.binary())], ["lang", "text", "slots"])
            if got:
                yield row()

        out = materialize(out.transform(shipped).mapInArrow(number, _STREAM if last else "lang string, text binary, slots binary"))
    return out


# --- streams ---------------------------------------------------------------------------------------------------------


def pack(slots: np.ndarray, words: np.ndarray | None) -> tuple[bytes, bytes | None]:
    """A stream without what no longer phrase can begin or end in: only runs of two or more frequent phrases stay, a break after each.

    On the first level a slot is its word's number, and ``words`` is left out.
    """
    ok = np.concatenate(([False], slots >= 0, [False]))
    run = ok[1:-1] & (ok[:-2] | ok[2:])
    keep = run | np.concatenate(([False], run[:-1]))
    out = np.where(run, slots, -1)[keep].astype("<i4").tobytes()
    return out, None if words is None else words[keep].astype("<i4").tobytes()


def pairs(batches, few: int = KEYS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From stream rows: slots and words of about ``few`` places together, each row ending with a break."""
    held, size = [], 0
    for batch in batches:
        for slots, words in zip(*batch.columns, strict=True):
            s = np.frombuffer(slots.as_py(), "<i4")
            held.append((s, np.frombuffer(words.as_py(), "<i4") if words.is_valid else s))
            held.append((np.array([-1], np.int32), np.array([-1], np.int32)))
            size += len(s)
            if size >= few:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def keys_at(slots: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where the phrase and the next one are both frequent, and the key of the phrase one word longer there."""
    at = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
    return at, slots[at].astype(np.int64) << 32 | words[at + 1].astype(np.int64)


def cells_of(keys: np.ndarray, cells: int) -> np.ndarray:
    return (_mix(keys.astype(np.uint64), 77) & np.uint64(cells - 1)).astype(np.int64)


@dataclass
class Index:
    """A minimal perfect hash with the key stored in each slot, so that a key that isn't there is told from one that is."""

    hash: PerfectHash
    keys: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> Index:
        mph = PerfectHash.build(keys)
        stored = np.empty(len(keys), np.int64)
        stored[mph.slots(keys)] = keys
        return cls(mph, stored)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 where it isn't there; every different key is looked up once."""
        if not len(self.keys) or not len(keys):
            return np.full(len(keys), -1, np.int64)
        own, back = np.unique(keys, return_inverse=True)
        slots = self.hash.slots(own)
        return np.where((slots >= 0) & (self.keys[slots] == own), slots, -1)[back]


def mappers(stream: DataFrame) -> DataFrame:
    """``stream`` in a few partitions a core, so that what each of them finds is sent a bounded number of times."""
    return stream.coalesce(max(1, MAPPERS * stream.sparkSession.sparkContext.defaultParallelism)).transform(shipped)


def tree_sum(stream: DataFrame, size: int, slots_of: Callable, finish: Callable[[np.ndarray], bytes]) -> bytes:
    """Counts of the numbers below ``size`` that ``slots_of`` finds in the stream, as ``finish`` tells of each chunk of them.

    A mapper counts in one array; arrays meet in chunks, first by chunk and one in FAN of the mappers, then by chunk.
    Mappers are bounded by the cores, so what they send is as well. The driver gets what ``finish`` makes of every chunk.
    """
    spark = stream.sparkSession
    chunks = -(-size // CHUNK)

    def send(total: np.ndarray, mapper: int) -> Iterator[pa.RecordBatch]:
        for c in range(chunks):
            part = total[c * CHUNK : (c + 1) * CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([mapper % FAN], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], ["chunk", "branch", "counts"])

    def count(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, np.int64)
        for slots, words in pairs(batches):
            found = slots_of(slots, words)
            total += np.bincount(found[found >= 0], minlength=size)
        yield from send(total, TaskContext.get().partitionId())

    def add(last: bool):
        def run(batches) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for c, branch, data in zip(*batch.columns, strict=True):
                    at, x = (c.as_py(), 0 if last else branch.as_py()), np.frombuffer(data.as_py(), "<i8")
                    held[at] = held[at] + x if at in held else x
            for (c, branch), x in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([branch], pa.int32()), pa.array([finish(x) if last else x.tobytes()], pa.binary())], ["chunk", "branch", "counts"])

        return run

    kind, n = "chunk int, branch int, counts binary", int(spark.conf.get("spark.sql.shuffle.partitions"))
    mapped = mappers(stream).mapInArrow(count, kind)
    branches = mapped.repartition(n, "chunk", "branch").mapInArrow(add(False), kind)
    table = branches.repartition(n, "chunk").mapInArrow(add(True), kind).toArrow()
    found = dict(zip(table["chunk"].to_pylist(), table["counts"].to_pylist(), strict=True))
    return b"".join(found[c] if c in found else finish(np.zeros(min(CHUNK, size - c * CHUNK), np.int64)) for c in range(chunks))


# --- levels ----------------------------------------------------------------------------------------------------------


@dataclass
class Level:
    """The frequent phrases of one length: their keys in a perfect hash, and by slot how often they occur."""

    index: Index
    counts: np.ndarray


def next_level(stream: DataFrame, min_count: int, cells: int) -> Level:
    """The frequent phrases one word longer than those of the stream."""
    spark = stream.sparkSession

    def sifted(slots: np.ndarray, words: np.ndarray) -> np.ndarray:
        return cells_of(keys_at(slots, words)[1], cells)

    open_ = spark.sparkContext.broadcast(tree_sum(stream, cells, sifted, lambda x: np.packbits(x >= min_count, bitorder="little").tobytes()))

    def through(slots: np.ndarray, words: np.ndarray) -> np.ndarray:
        keys = keys_at(slots, words)[1]
        at = cells_of(keys, cells)
        return keys[np.frombuffer(open_.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]

    def distinct(batches) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for slots, words in pairs(batches):
            held = np.union1d(held, through(slots, words))
            if len(held) > SLOTS:
                yield pa.RecordBatch.from_arrays([pa.array(held)], ["key"])
                held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["key"])

    candidates = materialize(mappers(stream).mapInArrow(distinct, "key long").distinct())
    passes = -(-candidates.count() // SLOTS)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(passes):
        own = candidates.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == p).toArrow()["key"].to_numpy()
        if not len(own):
            continue
        index = Index.build(own)
        held = spark.sparkContext.broadcast(index)

        def slots_of(slots: np.ndarray, words: np.ndarray, held=held) -> np.ndarray:
            return held.value.find(through(slots, words))

        n = np.frombuffer(tree_sum(stream, len(own), slots_of, lambda x: x.astype("<i8").tobytes()), "<i8")
        keys.append(index.keys[n >= min_count])
        counts.append(n[n >= min_count])
        held.unpersist()
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    if len(keys) > FREQUENT:
        raise ValueError(f"{len(keys)} phrases of a length are frequent; raise min_count, of which n / min_count is the bound")
    index = Index.build(keys)
    by_slot = np.empty(len(keys), np.int64)
    by_slot[index.hash.slots(keys)] = counts
    return Level(index, by_slot)


def advance(stream: DataFrame, level: Level) -> DataFrame:
    """The stream of the frequent phrases of ``level``."""
    held = stream.sparkSession.sparkContext.broadcast(level.index)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for slots, words in pairs(batches, BLOCK):
            at, keys = keys_at(slots, words)
            found = np.full(len(slots), -1, np.int64)
            found[at] = held.value.find(keys)
            a, b = pack(found, np.concatenate((words[1:], [-1])))
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.binary()), pa.array([b], pa.binary())], ["slots", "words"])

    return materialize(stream.transform(shipped).mapInArrow(run, _STREAM))


_PHRASE = "m int, slot long, head long, tail long, lang string, phrase string, a long, l long, r long, n long, score long"


def phrases(spark: SparkSession, levels: list[Level], vocabulary: list[pa.Table], totals: dict[str, int]) -> DataFrame:
    """A row for each frequent phrase of two words or more: its length and slot, the slots of the phrases without its last word
    (head) and without its first (tail), its language and words, and count, parts, all words and score by its lowest cut.

    A phrase's words and its left parts follow from its key; its right parts are looked up, and all counts read by slot.
    """
    held = spark.sparkContext.broadcast((levels, vocabulary, totals))
    ranges = [(m, low, min(low + CHUNK, len(level.counts))) for m, level in enumerate(levels, 1) if m > 1 for low in range(0, len(level.counts), CHUNK)]
    n_parts = max(1, min(len(ranges), 4096))
    places = spark.createDataFrame([(i % n_parts, *x) for i, x in enumerate(ranges)], "part int, m int, low long, high long").repartitionById(n_parts, F.col("part"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        every, known, every_n = held.value
        known = pa.concat_tables(known)
        for batch in batches:
            for _, m, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left, words = {m: np.arange(low, high)}, np.zeros((high - low, m), np.int64)
                for k in range(m, 1, -1):
                    key = every[k - 1].index.keys[left[k]]
                    left[k - 1], words[:, k - 1] = key >> 32, key & 0xFFFFFFFF
                words[:, 0] = left[1]
                right = {}
                for k in range(1, m):
                    right[k] = words[:, k]
                    for j in range(k + 1, m):
                        right[k] = every[j - k].index.find(right[k] << 32 | words[:, j])
                cuts = [list(zip(every[k - 1].counts[left[k]].tolist(), every[m - k - 1].counts[right[k]].tolist(), strict=True)) for k in range(1, m)]
                texts = [known["word"].take(pa.array(words[:, k])).to_pylist() for k in range(m)]
                langs = known["lang"].take(pa.array(words[:, 0])).to_pylist()
                out = []
                for lang, a, parts, own in zip(langs, every[m - 1].counts[low:high].tolist(), zip(*cuts, strict=True), zip(*texts, strict=True), strict=True):
                    n = every_n[lang]
                    score, _, l, r = min((1000 * a * n // (l * r), k, l, r) for k, (l, r) in enumerate(parts))  # whole numbers of any size
                    out.append((lang, b" ".join(own).decode(), a, l, r, n, score))
                fixed = [pa.array(np.full(high - low, m), pa.int32()), *(pa.array(x, pa.int64()) for x in (left[m], left[m - 1], right[1]))]
                kinds = [pa.string()] * 2 + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], [f.split()[0] for f in _PHRASE.split(", ")])

    return places.transform(shipped).mapInArrow(run, _PHRASE)


def mine(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, inside: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z is lower-cased; texts are split at ``.,;:!?`` and line ends into pieces, pieces at spaces and tabs into words.
    Phrases of 2 to ``longest`` words with a = f(phrase) of ``min_count`` or more are cut in two with counts l and r; the
    cut with the lowest floor(1000 a n / (l r)) counts, of equal ones that with the shorter first part; n is all words of the
    language. A phrase inside a longer one that occurs at least ``inside`` hundredths as often is dropped. Order: score and
    a falling, then phrase.

    A null text has no words, a null language is ``und``; repeated rows count each time; texts of any length are read
    whole; an empty table, or one in which no phrase is frequent, gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    counted = materialize(word_counts(rows).where(F.col("n") >= min_count))  # a language with fewer words has no phrase
    known = counted.where(F.col("word").isNotNull()).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    totals = {r["lang"]: r["n"] for r in counted.where(F.col("word").isNull()).collect()}  # at most n / min_count, as the words
    if len(known) > FREQUENT:
        raise ValueError(f"{len(known)} words are frequent; raise min_count, of which n / min_count is the bound")
    known = known.append_column("number", pa.array(np.arange(len(known)), pa.int32()))
    levels = [Level(Index.build(np.zeros(0, np.int64)), known["n"].to_numpy())]
    vocabulary = [known.select(["lang", "word", "number"]).slice(i, VOCABULARY) for i in range(0, len(known), VOCABULARY)]
    cells = min(MOST_CELLS, 1 << max(10, (CELLS * sum(totals.values()) // min_count).bit_length()))
    stream = encode(rows, vocabulary) if vocabulary else None
    while stream is not None and len(levels) < longest:
        level = next_level(stream, min_count, cells)
        if not len(level.counts):
            break
        levels.append(level)
        if len(levels) < longest:
            stream = advance(stream, level)
    found = materialize(phrases(spark, levels, vocabulary or [known.select(["lang", "word", "number"])], totals))
    around = found.where("m > 2").select((F.col("m") - 1).alias("m"), F.explode(F.array("head", "tail")).alias("slot"), "a")
    longer = around.groupBy("m", "slot").agg(F.max("a").alias("longer"))
    # what lies inside a longer candidate lies inside one that is longer by a word, which is as frequent at least
    whole = found.join(longer, ["m", "slot"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
