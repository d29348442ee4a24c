"""Operator 2: WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about ``FRAME_BYTES``; a bundle file is a row of frames and ends
with the seek table of the seekable format (a skippable frame whose footer a reader finds at the end of the file). An
index table maps each record identifier to bundle, frame and offset inside the frame.

Payloads that occur before are written as revisit records: of equal payloads of at least ``LEAST_BYTES`` the record with
the smallest id is the response. Frequent payload digests are found with Misra-Gries counters and their first records
broadcast (at most ``exact_dedup.COUNTERS`` rows); others meet by an ordinary shuffle.

Bundles are written to the shared folder under a name of their own for each task attempt; only names that the committed
index holds are read, so a lost executor or a repeated task leaves no trace in the result.

Cases: a null payload counts as empty; a null id is written as an empty identifier and read back as null; a null url
gives no target header; rows with the same id and payload are all of the same type; an empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm import exact_dedup
from auditspark.llm.shared import shared_folder, slices, written

#: Least payload for a revisit record.
LEAST_BYTES = 100
#: Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
#: Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str, mode: str):
    """A binary file of a shared store: a mounted path, or any store that pyarrow reaches by its URI."""
    path = uri.removeprefix("file://") if uri.startswith("file:///") else uri.removeprefix("file:")
    if "://" not in path:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    if mode == "wb":
        store.create_dir(os.path.dirname(inside), recursive=True)
        return store.open_output_stream(inside)
    return store.open_input_file(inside)


def record(identifier: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record: the HTTP response with its payload, or its headers only in a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{identifier}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(frame: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at an offset: its headers, its block, and where the next one starts."""
    end = frame.index(b"\r\n\r\n", at)
    lines = frame[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at offset {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    stop = end + 4 + int(head["Content-Length"])
    return head, frame[end + 4 : stop], stop + 4


class BundleWriter:
    """Writes records into frames and frames into one bundle file."""

    def __init__(self, uri: str, level: int = 3):
        import zstandard

        self.uri, self.out = uri, opened(uri, "wb")
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.inside = self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset inside it) of the record."""
        place = len(self.frames), self.inside
        self.parts.append(data)
        self.inside += len(data)
        if self.inside >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.parts:
            frame = self.compress(b"".join(self.parts))
            self.out.write(frame)
            self.frames.append((len(frame), self.inside))
            self.size += len(frame)
            self.parts, self.inside = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(uri: str) -> list[tuple[int, int]]:
    """(offset, compressed size) of every frame of a bundle, read from its end."""
    with opened(uri, "rb") as f:
        end = f.seek(0, 2) or f.tell()
        f.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        f.seek(end - 9 - n * width)
        data = f.read(n * width)
    out, at = [], 0
    for k in range(n):
        size = struct.unpack_from("<I", data, k * width)[0]
        out.append((at, size))
        at += size
    return out


def frame_bytes(uri: str, offset: int, size: int) -> bytes:
    import zstandard

    with opened(uri, "rb") as f:
        f.seek(offset)
        return zstandard.ZstdDecompressor().decompress(f.read(size))


def with_revisits(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = LEAST_BYTES) -> DataFrame:
    """(id, url, payload, digest, refers_to) of every row; ids as text."""
    payload = F.coalesce(df[payload_col].cast("string"), F.lit(""))
    rows = df.select(df[id_col].alias("id"), df[url_col].cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    keys = written(rows.where(F.octet_length("payload") >= least).select("id", "digest"), "payload-digests")
    hot = written(exact_dedup.frequent(keys), "frequent-payloads")
    cold = keys.join(F.broadcast(hot.select("digest")), "digest", "left_anti").groupBy("digest").agg(F.min("id").alias("cold_id"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("key"), "cold_id")
    rows = rows.join(F.broadcast(hot.select("digest", F.col("keep_id").alias("hot_id"))), "digest", "left")
    settled = F.col("hot_id").isNotNull() | (F.octet_length("payload") < least)  # has no partner in the shuffle: any key will do
    rows = rows.withColumn("key", F.when(settled, F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))).otherwise(F.col("digest")))
    rows = rows.join(cold, "key", "left")
    first = F.coalesce("hot_id", "cold_id")
    return rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(first), first).cast("string").alias("refers_to"))


def write_bundles(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (id, url, payload, digest, refers_to) as bundles and returns the committed index (id, bundle, frame, offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for b in slices(batches):
            out = []
            for identifier, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    writer = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                data = record(identifier or "", url, payload.encode(), digest, refers_to)
                out.append((identifier, writer.uri, *writer.add(data), len(data)))
                if writer.size >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "bundle", "frame", "offset", "length"])
        if writer:
            writer.close()

    return written(rows.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, "id string, bundle string, frame int, offset long, length long"), "warc-index")


def _described(head: dict[str, str], block: bytes) -> tuple[str, int, str, str, str | None]:
    identifier = head["WARC-Record-ID"][len("<urn:page:") : -1]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {identifier} was damaged")
    return identifier or None, size, digest, head["WARC-Type"], head["WARC-Refers-To"][len("<urn:page:") : -1] if "WARC-Refers-To" in head else None


def read_bundles(index: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every record of the bundles that the index names.

    Frames are listed from the seek tables and dealt out one by one; payloads are digested anew.
    """

    def list_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(uri, k, *frame) for uri in b.column(0).to_pylist() for k, frame in enumerate(seek_table(uri))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["bundle", "frame", "at", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, at, size in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data, out, here = frame_bytes(uri, at, size), [], 0
                while here < len(data):
                    head, block, here = parsed(data, here)
                    out.append(_described(head, block))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    frames = index.select("bundle").distinct().mapInArrow(list_frames, "bundle string, frame int, at long, size long")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.repartition(parts, "bundle", "frame").mapInArrow(read, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def fetch(index: DataFrame) -> DataFrame:
    """(id, record binary) of the index rows given: random access by frame and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list[tuple[int, int]]] = {}
        for b in batches:
            out = []
            for uri, frame, offset, length in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if uri not in tables:
                    tables[uri] = seek_table(uri)
                out.append(frame_bytes(uri, *tables[uri][frame])[offset : offset + length])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "record"])

    return index.select("id", "bundle", "frame", "offset", "length").mapInArrow(run, "id string, record binary")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to bundles and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_bundles(with_revisits(pages, "page_id", "url", "html"), shared_folder(spark, "bundles"))
    return read_bundles(index).select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM q
"""
