"""WARC archives compressed record by record with a Zstandard dictionary built from their own records.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each record then
is a frame of its own. Records whose payload another record has already stored are revisits and carry
the payload's length and digest only.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import attempt_name, materialize, open_fs, shared_dir, shipped

SKIPPABLE = 0x184D2A5D
#: The dictionary is built from an archive's first records, as many as these bounds allow; of each, so many bytes.
SAMPLE_RECORDS, SAMPLE_BYTES, SAMPLE_CLIP, DICT_BYTES = 200, 1 << 20, 64 << 10, 32 << 10
#: Fewer records than LEAST_RECORDS train no dictionary (their own bytes are it then); long ones are waited for until so
#: many bytes are held.
LEAST_RECORDS, HELD_BYTES = 8, 32 << 20
#: An archive is closed beyond so many bytes before compression.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
#: Payloads of fewer bytes are always stored in full.
MIN_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; ``payload`` is left out of revisits."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    else:
        block += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's fields, its HTTP header and what follows that."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, body = rest[:n].partition(b"\r\n\r\n")
    return fields, http, body


class ArchiveWriter:
    """Writes one archive; holds back the first records until the dictionary is built from them."""

    def __init__(self, sink):
        self.sink, self.held, self.size, self.zstd = sink, [], 0, None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        if self.zstd:
            self.sink.write(self.zstd.compress(data))
            return
        self.held.append(data)
        if len(self.held) >= SAMPLE_RECORDS or self.size >= (SAMPLE_BYTES if len(self.held) >= LEAST_RECORDS else HELD_BYTES):
            self._start()

    def _dictionary(self) -> bytes:
        """Trained on the held records; where these are too few or have too little in common, their own bytes, the first nearest the end."""
        import zstandard

        samples = [x[:SAMPLE_CLIP] for x in self.held]
        if len(samples) >= LEAST_RECORDS:
            with suppress(zstandard.ZstdError):
                return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        return b"".join(x[: max(8, DICT_BYTES // len(samples))] for x in reversed(samples))[-DICT_BYTES:]

    def _start(self) -> None:
        import zstandard

        data = self._dictionary()
        self.sink.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        made = zstandard.ZstdCompressionDict(data)
        made.precompute_compress(level=LEVEL)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=True)
        for x in self.held:
            self.sink.write(self.zstd.compress(x))
        self.held = []

    def close(self) -> None:
        if not self.zstd:
            self._start()
        self.sink.close()


def records(uri: str, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as source:
        magic, n = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri} has no dictionary frame")
        zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(n)))
        data = source.read(chunk)
        while data:
            frame, out = zstd.decompressobj(), []
            while not frame.eof:
                if not data:
                    raise ValueError(f"{uri} ends inside a record")
                out.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else source.read(chunk)
            yield b"".join(out)
            data = data or source.read(chunk)


def write(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive ``pages``; returns the manifest (path, n_records).

    Which record holds a payload is settled on a table of keys and digests; the pages are read twice, once for that
    table, and move once, by key, whose rows are few however common a payload is.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), body.alias("body")).withColumn("digest", F.sha2("body", 256)).withColumn("n", F.octet_length("body").cast("long"))
    heads = materialize(rows.where(F.col("n") >= MIN_REVISIT).select("k", "digest"))
    seen = heads.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("times"))
    again = seen.where("times > 1").select("digest", "first")
    keys = heads.distinct().join(again, "digest").where("not (k <=> first)").select(F.col("k").alias("rk"), F.col("digest").alias("rd"), "first")
    marked = rows.join(keys, F.col("k").eqNullSafe(F.col("rk")) & (F.col("digest") == F.col("rd")), "left").withColumn("revisit", F.col("first").isNotNull())
    marked = marked.select("k", "u", F.when(~F.col("revisit"), F.col("body")).alias("body"), "n", "digest", "first", "revisit")

    def save(batches):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        (part, suffix), done, out, n = attempt_name(), [], None, 0

        def close() -> None:
            out.close()
            name = f"pages-{part:06d}-{len(done):04d}.warc.zst"
            fs.move(f"{base}/{name}{suffix}", f"{base}/{name}")
            done.append({"path": f"{folder}/{name}", "n_records": n})

        for batch in batches:
            for k, u, payload, size, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    sink = fs.open_output_stream(f"{base}/pages-{part:06d}-{len(done):04d}.warc.zst{suffix}", compression=None, buffer_size=1 << 20)
                    out, n = ArchiveWriter(sink), 0
                out.add(record(k, u, payload or b"", size, digest, first, revisit))
                n += 1
                if out.size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return materialize(marked.transform(shipped).mapInArrow(save, "path string, n_records long"), folder + "-manifest")


def read(spark: SparkSession, manifest: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per archived record, from the archives alone; a payload that belies its digest is an error."""
    types = pa.schema([("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def page(text: str) -> int | None:
        value = text.removeprefix("<urn:page:").removesuffix(">")
        return None if value in ("null", "None") else int(value)

    def load(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = []
                for data in records(path):
                    fields, http, payload = parse(data)
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    n = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    out.append({"key": page(fields["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": page(fields["WARC-Refers-To"]) if kind == "revisit" else None})
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_pylist(out, types)
                        out = []
                yield pa.RecordBatch.from_pylist(out, types)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    paths = manifest.select("path").repartition(n)  # whole archives, dealt in turn
    return paths.transform(shipped).mapInArrow(load, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long").withColumnRenamed("key", key)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive to the shared folder and read back.

    A null page is an empty payload. Of equal payloads of 100 bytes or more, the smallest key's record is the
    response; rows that repeat that key and payload are responses too. A null key never is the smallest unless
    all are null, and then all are responses. Only key, url and html are read; no pages give no archives.
    """
    return read(pages.sparkSession, write(pages, None, key, url, html), key)
