"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records.  After the data frames
come a skippable frame with the record map (identifier -> frame, offset in the uncompressed frame, length)
and the footer seek table of the seekable format (also a skippable frame), so any record is read by
decoding one frame.
"""

from __future__ import annotations

import itertools
import json
import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import exact, ids_of, listed
from ._shared import dealt, reading, shared_dir, staged, writing

# Fixed values of the file format.
SKIPPABLE_MAP = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_MIN_BYTES = 1000
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20

INDEX_SCHEMA = "page_id long, path string, frame int, offset long, length long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class BundleWriter:
    """Streams records into one bundle; holds at most one frame and the record map."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.codec = zstandard.ZstdCompressor(level=level)
        self.buffer, self.filled, self.frames, self.records, self.written = [], 0, [], [], 0

    def add(self, record_id, record: bytes) -> tuple[int, int, int]:
        if self.filled and self.filled + len(record) > self.frame_bytes:
            self.flush()
        at = (len(self.frames), self.filled, len(record))
        self.records.append((record_id, *at))
        self.buffer.append(record)
        self.filled += len(record)
        return at

    def flush(self) -> None:
        if self.filled:
            packed = self.codec.compress(b"".join(self.buffer))
            self.sink.write(packed)
            self.frames.append((len(packed), self.filled))
            self.written += len(packed)
            self.buffer, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        body = self.codec.compress(json.dumps(self.records).encode())
        self.sink.write(struct.pack("<II", SKIPPABLE_MAP, len(body)) + body)
        frames = [*self.frames, (8 + len(body), 0)]
        table = b"".join(struct.pack("<II", *f) for f in frames) + FOOTER.pack(len(frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)


class BundleReader:
    """Random access by the seek table: a record costs one range read and one frame's decoding."""

    def __init__(self, source):
        import zstandard

        self.source, self.codec = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - FOOTER.size)
        n, _, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable bundle")
        source.seek(size - FOOTER.size - 8 * n)
        table = source.read(8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.source.seek(at)
        return self.codec.decompress(self.source.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]

    def record_map(self) -> list[list]:
        at, packed, _ = self.frames[-1]
        self.source.seek(at + 8)
        return json.loads(self.codec.decompress(self.source.read(packed - 8)))


def encode_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its HTTP block, or a revisit without the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(" " if c in "\r\n" else c for c in url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> dict:
    """One record.  Lengths and digests of responses are taken anew from the stored payload."""
    import hashlib

    end = data.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    http, _, payload = data[end + 4 : end + 4 + int(head["Content-Length"])].partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    revisit = head["WARC-Type"] == "revisit"
    ident = lambda x: int(i) if (i := x[len("<urn:page:") : -1]) else None
    return {
        "page_id": ident(head["WARC-Record-ID"]),
        "url": head.get("WARC-Target-URI"),
        "record_type": head["WARC-Type"],
        "refers_to": ident(head["WARC-Refers-To"]) if revisit else None,
        "payload_bytes": length if revisit else len(payload),
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
        "payload": None if revisit else payload,
    }


def with_revisits(pages: DataFrame, min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to.

    Equal payloads are found by SHA-256; only digests meet in the aggregation, which combines on the map
    side, and payloads move once, by a join that AQE splits where one payload is very common.  Rows whose
    payload is short or whose page_id is null get a key of their own, so they gather nowhere.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")).withColumn("payload", F.col("payload").cast("binary"))
    shared = (F.length("payload") >= min_bytes) & F.col("page_id").isNotNull()
    rows = rows.withColumn("key", F.when(shared, F.sha2("payload", 256)).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("#"), F.xxhash64("payload").cast("string"))))
    holder = rows.filter(~F.col("key").startswith("#")).groupBy("key").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    return rows.join(holder, "key", "left").select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.when(F.col("holder") != F.col("page_id"), F.col("holder")).alias("refers_to"))


def write_bundles(pages: DataFrame, directory: str, *, min_bytes: int = REVISIT_MIN_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one record for each row of ``pages`` (page_id, url, html) and return the index of records.

    Null html is an empty payload; a null page_id is kept as a response without identifier; a repeated row
    is a record of its own; other columns are ignored; an empty table writes no bundle.
    """

    def write(batches):
        state = {}

        def close():
            if state:
                state["out"].close()
                state["ctx"].__exit__(None, None, None)
                rows = pd.DataFrame([(state["path"], *r[1:]) for r in state["out"].records], columns=["path", "frame", "offset", "length"])
                rows.insert(0, "page_id", listed([r[0] for r in state["out"].records]))
                state.clear()
                return rows
            return None

        for pdf in batches:
            for page_id, url, payload, digest, refers_to in zip(ids_of(pdf, "page_id"), pdf["url"], pdf["payload"], pdf["digest"], ids_of(pdf, "refers_to"), strict=True):
                if not state:
                    path = f"{directory}/{uuid.uuid4().hex}.warc.zst"
                    ctx = writing(path)
                    state |= {"path": path, "ctx": ctx, "out": BundleWriter(ctx.__enter__(), frame_bytes)}
                known = lambda x: None if pd.isna(x) else int(x)
                state["out"].add(known(page_id), encode_record(known(page_id), url, bytes(payload), digest, known(refers_to)))
                if state["out"].written > bundle_bytes and (rows := close()) is not None:
                    yield rows
        if (rows := close()) is not None:
            yield rows

    return with_revisits(pages, min_bytes).select("url", "payload", "digest", *exact("page_id", "refers_to")).mapInPandas(write, INDEX_SCHEMA)


def read_bundles(spark: SparkSession, index: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that ``index`` names, by each bundle's own record map: a frame is decoded once, by the seek table,
    and each of its records is taken from its offset.  One frame is in memory at a time."""

    def read(batches):
        for pdf in batches:
            for path in pdf["path"]:
                with reading(path) as source:
                    bundle = BundleReader(source)
                    for frame, records in itertools.groupby(bundle.record_map(), key=lambda r: r[1]):
                        data = bundle.frame(frame)
                        decoded = [decode_record(data[at : at + length]) for _, _, at, length in records]
                        rows = pd.DataFrame({c: listed([r[c] for r in decoded]) if c in ("page_id", "refers_to") else [r[c] for r in decoded] for c in decoded[0]})
                        if not payloads:
                            rows["payload"] = None
                        yield rows

    return dealt(index.select("path").distinct()).mapInPandas(read, RECORD_SCHEMA)


def read_record(index_row) -> dict:
    """One record by its index row (path, frame, offset, length)."""
    with reading(index_row["path"]) as source:
        return decode_record(BundleReader(source).record(index_row["frame"], index_row["offset"], index_row["length"]))


def archive_digest(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to bundles in the shared folder, read them back, and give a row for each record.

    Null html is an empty payload; rows without page_id are responses and nothing refers to them; a repeated row is a record of its own,
    and no record refers to its own page_id; an empty table gives no rows.
    """
    spark = pages.sparkSession
    directory = shared_dir(spark)
    index = staged(write_bundles(pages, f"{directory}/bundles", **options), directory, "index")
    return read_bundles(spark, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
