"""Token ids in binary shards, each with a minimal perfect hash index from document key to place.

A shard file holds, in ascending key order, the raw ids of its documents (little-endian, 2 or 4 bytes
each), then the index: places of documents, the levels of the hash function, and per slot a fingerprint
of the key and the document's number. A last block of fixed size says where each part lies.

The hash function is built by levels (Limasset et al., 2017): keys that meet no other on a level own a
bit there, the others go on to the next; a key's slot is the number of set bits before its own. That number is
stored for every block of 512 bits, so a key is found by a few reads of fixed size, however large the shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import attempt_name, materialize, open_fs, shared_dir, shipped
from tessera.llm.tok import encoder

MAGIC = b"TSBIN002"
#: magic, id width, documents, documents without key, distinct keys, ids, places of starts, keys, levels, slots
TAIL = struct.Struct("<8sIQQQQQQQQ")
GAMMA, LEVELS = 2, 64
#: Bytes of a block of bits with a stored rank, and keys looked up at once.
RANKED, BATCH = 64, 1 << 14
#: Size of the sketch of keys: bounds are off by about 0.1 % of all rows.
SKETCH = 4096
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function (splitmix64) of unsigned keys."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: per level its number of bits, the bits, and the set bits before each block."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], size: int):
        self.levels, self.size = levels, size

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, seen = [], keys.astype(np.uint64), 0
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            m = max(64, GAMMA * len(left))
            at = (_mix(left, len(levels)) % np.uint64(m)).astype(np.int64)
            own = np.bincount(at, minlength=-(-m // (8 * RANKED)) * 8 * RANKED) == 1
            before = seen + np.concatenate(([0], np.cumsum(own.reshape(-1, 8 * RANKED).sum(1))))
            levels.append((m, np.packbits(own, bitorder="little"), before[:-1].astype("<u8")))
            seen = int(before[-1])
            left = left[~own[at]]
        return cls(levels, seen)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level has it (a key that was never put in may get any slot)."""
        keys = keys.astype(np.uint64)
        return np.concatenate([self._slots(keys[i : i + BATCH]) for i in range(0, len(keys), BATCH)]) if len(keys) else np.zeros(0, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (m, bits, before) in enumerate(self.levels):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(m)).astype(np.int64)
            hit = bits[at >> 3] >> (at & 7) & 1 == 1
            block, within = at[hit] // (8 * RANKED), at[hit] % (8 * RANKED)
            ones = np.concatenate((np.zeros((len(block), 1), np.int64), np.cumsum(_ONES[bits.reshape(-1, RANKED)[block]], 1)), 1)
            low = _ONES[bits[at[hit] >> 3] & ((1 << (at[hit] & 7)) - 1)]
            out[open_[hit]] = before[block].astype(np.int64) + ones[np.arange(len(block)), within >> 3] + low
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        """Number of levels and set bits, bits of each level, then each level's bits and ranks."""
        head = struct.pack("<IQ", len(self.levels), self.size) + b"".join(struct.pack("<Q", m) for m, _, _ in self.levels)
        return head + b"".join(bits.tobytes() + before.tobytes() for _, bits, before in self.levels)

    @staticmethod
    def places(read: Callable[[int, int], bytes]) -> tuple[int, list[tuple[int, int, int]]]:
        """Size, and per level its bits and where bits and ranks lie, given ``read(n, at)``."""
        n, size = struct.unpack("<IQ", read(12, 0))
        at, out = 12 + 8 * n, []
        for m in struct.unpack(f"<{n}Q", read(8 * n, 12)):
            blocks = -(-m // (8 * RANKED))
            out.append((m, at, at + blocks * RANKED))
            at += blocks * (RANKED + 8)
        return size, out

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        size, places = cls.places(lambda n, at: data[at : at + n])
        return cls([(m, np.frombuffer(data, np.uint8, ranks - bits, bits), np.frombuffer(data, "<u8", (ranks - bits) // RANKED, ranks)) for m, bits, ranks in places], size)

    @staticmethod
    def slot(key: int, places: list[tuple[int, int, int]], read: Callable[[int, int], bytes]) -> int:
        """One key's slot by reads of a block and its rank a level."""
        for level, (m, bits, ranks) in enumerate(places):
            at = int(_mix(np.array([key], np.int64).astype(np.uint64), level)[0]) % m
            block, within = divmod(at, 8 * RANKED)
            word = int.from_bytes(read(RANKED, bits + block * RANKED), "little")
            if word >> within & 1:
                return struct.unpack("<Q", read(8, ranks + 8 * block))[0] + (word & (1 << within) - 1).bit_count()
        return -1


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.uint64), 1000) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    """Writes one shard, documents given in ascending key order with those without key first."""

    def __init__(self, out, width: int):
        self.out, self.width, self.starts, self.keys, self.nulls, self.n = out, width, [0], [], 0, 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.n += len(ids) // self.width
        self.starts.append(self.n)
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)

    def finish(self) -> None:
        keys = np.array(self.keys, np.int64)
        distinct, firsts = np.unique(keys, return_index=True)
        mph = PerfectHash.build(distinct)
        slots = np.zeros(len(distinct), [("fingerprint", "<u4"), ("document", "<u8")])
        at = mph.slots(distinct)
        slots["fingerprint"][at], slots["document"][at] = fingerprints(distinct), firsts + self.nulls
        parts, place, places = [np.array(self.starts, "<u8").tobytes(), keys.astype("<i8").tobytes(), mph.dump(), slots.tobytes()], self.n * self.width, []
        for p in parts:
            places.append(place)
            place += len(p)
            self.out.write(p)
        self.out.write(TAIL.pack(MAGIC, self.width, len(self.starts) - 1, self.nulls, len(distinct), self.n, *places))


SLOT = np.dtype([("fingerprint", "<u4"), ("document", "<u8")])


class ShardReader:
    """Reads a shard: any key's ids in constant time and memory, or all documents in order."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.uri, self.file = uri, fs.open_input_file(path)
        size = self.file.size()
        self.end = size - TAIL.size
        magic, self.width, self.docs, self.nulls, self.distinct, self.ids, *places = TAIL.unpack(self.file.read_at(TAIL.size, self.end))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.at_starts, self.at_keys, self.at_levels, self.at_slots = places
        size, self.levels = PerfectHash.places(self._level)
        if size != self.distinct:
            raise ValueError(f"{uri}: its index is damaged")

    def _level(self, n: int, at: int) -> bytes:
        return self.file.read_at(n, self.at_levels + at)

    def get(self, key: int) -> np.ndarray | None:
        """The ids of the first document with ``key``; null if there is none. Reads a few blocks of fixed size and the ids."""
        slot = PerfectHash.slot(key, self.levels, self._level)
        if slot < 0:
            return None
        fingerprint, document = np.frombuffer(self.file.read_at(SLOT.itemsize, self.at_slots + SLOT.itemsize * slot), SLOT)[0]
        if fingerprint != fingerprints(np.array([key], np.int64))[0]:
            return None
        own = struct.unpack("<q", self.file.read_at(8, self.at_keys + 8 * (int(document) - self.nulls)))[0]
        return self.read(int(document)) if own == key else None

    @cached_property
    def starts(self) -> np.ndarray:
        return np.frombuffer(self.file.read_at(self.at_keys - self.at_starts, self.at_starts), "<u8")

    @cached_property
    def keys(self) -> np.ndarray:
        return np.frombuffer(self.file.read_at(self.at_levels - self.at_keys, self.at_keys), "<i8")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's first document, or -1 for a key whose fingerprint isn't there."""
        at = PerfectHash.load(self._level(self.at_slots - self.at_levels, 0)).slots(keys)
        slots = np.frombuffer(self.file.read_at(self.end - self.at_slots, self.at_slots), SLOT)
        if not len(slots):
            return np.full(len(keys), -1, np.int64)
        hit = slots[np.maximum(at, 0)]
        return np.where((at >= 0) & (hit["fingerprint"] == fingerprints(keys)), hit["document"].astype(np.int64), -1)

    def read(self, document: int) -> np.ndarray:
        a, b = struct.unpack("<QQ", self.file.read_at(16, self.at_starts + 8 * document))
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def __iter__(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(key, start, ids as little-endian 32-bit bytes), each found by its key through the index."""
        found = self.find(self.keys)
        if len(self.keys) and not (self.keys[found - self.nulls] == self.keys).all():
            raise ValueError("the index leads to another document")
        # repeats of a key follow its first document
        nth = np.arange(len(self.keys)) - (found - self.nulls)
        numbers = [*range(self.nulls), *(found + nth).tolist()]
        for k, d in enumerate(numbers):
            key, a, b = None if k < self.nulls else int(self.keys[k - self.nulls]), int(self.starts[d]), int(self.starts[d + 1])
            yield key, a, np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}").astype("<u4").tobytes()


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as token shards; returns the manifest (bucket, path, n_docs, n_tokens).

    Keys are dealt to shards by ranges, whose bounds are quantiles of the keys themselves (a sketch of whole longs).
    Where one key fills several ranges its rows are dealt evenly over them, so a key with a third of all rows is no
    larger a task; rows without a key come first, in shards of their own as many as they need. A shard is written
    under a name of its own attempt and then moved, so that a repeated task replaces it whole.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    k = F.col(key).cast("long")
    stats = docs.agg(F.kll_sketch_agg_bigint(k, F.lit(SKETCH)).alias("s"), F.count(k).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    bare = -(-n * (stats["rows"] - stats["n"]) // max(1, stats["rows"]))  # shards for rows without a key
    ranks = F.array(*(F.lit(i / n) for i in range(1, n)))
    cuts = spark.createDataFrame([(bytes(stats["s"]),)], "s binary").select(F.kll_sketch_get_quantile_bigint("s", ranks)).first()[0] if n > 1 and stats["n"] else []
    bounds = np.array(sorted(cuts), np.int64)

    def tokens(batches):
        enc = encoder(tokenizer)
        end, turn = end_id.to_bytes(enc.width, "little"), 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            given = np.array([x is not None for x in keys.to_pylist()], bool)
            k = keys.fill_null(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, k, "left"), np.searchsorted(bounds, k, "right")
            turns = turn + np.arange(len(k))
            turn += len(k)
            # a key that several bounds equal is dealt over the ranges between them
            bucket = np.where(given, bare + np.where(high - low > 1, low + turns % (high - low + 1), low), turns % max(1, bare))
            ids = pa.array([enc.encode(t.as_py()) + end for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), keys, ids], ["bucket", "key", "ids"])

    def save(batches):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        width, (_, suffix) = encoder(tokenizer).width, attempt_name()
        now, out, sink, done = None, None, None, []

        def close() -> None:
            out.finish()
            sink.close()
            name = f"{base}/tokens-{now:06d}.bin"
            fs.move(name + suffix, name)
            done.append((now, f"{folder}/tokens-{now:06d}.bin", len(out.starts) - 1, out.n))

        for batch in batches:
            for bucket, k, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if out:
                        close()
                    now = bucket
                    sink = fs.open_output_stream(f"{base}/tokens-{now:06d}.bin{suffix}", compression=None, buffer_size=1 << 20)
                    out = ShardWriter(sink, width)
                out.add(k, ids)
        if out:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "path", "n_docs", "n_tokens"), x, strict=True)) for x in done], pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    ids = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).transform(shipped).mapInArrow(tokens, "bucket int, key long, ids binary")
    dealt = ids.repartitionById(n + bare, F.col("bucket")).sortWithinPartitions("bucket", "key")
    return materialize(dealt.transform(shipped).mapInArrow(save, "bucket int, path string, n_docs long, n_tokens long"), folder + "-manifest")


def read(spark: SparkSession, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read shards back: per document key, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = manifest.orderBy("bucket").collect()  # a row per shard
    base, before = {}, 0
    for r in rows:
        base[r["path"]] = before
        before += r["n_tokens"]
    paths = spark.createDataFrame([(i, r["path"], base[r["path"]]) for i, r in enumerate(rows)], "i int, path string, base long")

    def load(batches):
        schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out = []
                for k, start, ids in ShardReader(path):
                    out.append({"key": k, "start": at + start, "n_tokens": len(ids) // 4, "ids_crc32": zlib.crc32(ids)})
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    spread = paths.repartitionById(max(1, len(rows)), F.col("i"))
    return spread.transform(shipped).mapInArrow(load, "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write shards to the shared folder and read them back.

    A null or empty text has the end id alone. A null key comes first and is not in the index; rows that
    repeat a key follow one another. Only key and text are read. An empty table gives no shards and no rows.
    """
    return read(docs.sparkSession, write(docs, tokenizer, None, end_id, key, text), key)
