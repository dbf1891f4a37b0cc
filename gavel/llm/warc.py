"""WARC bundles with random access: records in independent Zstandard frames, a footer seek table and a record index.

Each task writes its records, sorted by page_id, into bundles. Inside a bundle, consecutive records
share a frame of about `FRAME_BYTES`; the frames are followed by one skippable
frame with each frame's compressed and plain size (the public seekable format),
so a reader fetches the footer, then one frame. The index maps a record's id to
(bundle, frame, offset in the frame's plain bytes). Of the records whose
payloads are equal and have at least `least_bytes` bytes, the one of the
largest page_id is the response and the others are revisits that refer to it;
a revisit stores no payload.

Spark writes bundles as a Parquet table (bundle, data, index) in the shared
folder, so bundles of lost executors are written again by the commit protocol.

Defined results: null html is an empty payload; a null page_id sorts first and
is never the larger one; rows of one page_id and payload are alike (all
response or all revisit); a null url is an empty target; an empty table gives
no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.store import fresh_path

# Fixed values of the public formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_BYTES = 128 << 10
BUNDLE_BYTES = 8 << 20
_DATE = "1970-01-01T00:00:00Z"
_BUNDLE = "bundle string, data binary, index array<struct<page_id:long,frame:int,offset:int>>"


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the payload's digest and size but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {_DATE}", "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(plain: bytes, offset: int) -> tuple[dict[str, str], bytes]:
    """The headers and the block of the record at offset."""
    stop = plain.index(b"\r\n\r\n", offset)
    lines = plain[offset:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record starts here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return head, plain[stop + 4 : stop + 4 + int(head["Content-Length"])]


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Compressed frames (bytes, plain size) with the seek table behind them."""
    table = b"".join(struct.pack("<II", len(f), n) for f, n in frames)
    body = table + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return b"".join(f for f, _ in frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, read from the footer alone."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    out, at = [], 0
    for c, p in struct.iter_unpack("<II", data[-9 - 8 * n : -9]):
        out.append((at, c, p))
        at += c
    return out


def open_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    start, size, plain = frame
    return zstandard.ZstdDecompressor().decompress(data[start : start + size], max_output_size=max(1, plain))


#: Parts that the pages of one payload are dealt into.
SALTS = 16


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages as (page_id, url, html, refers_to, revisit).

    Payloads that several pages have are one row each, copied to SALTS parts; a page joins the copy of its part, so a
    payload that very many pages have is no hot key.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("size"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("part"))
    heads = keyed.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null")
    heads = heads.select("digest", "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    met = keyed.join(heads, ["digest", "part"], "left")
    follows = F.col("page_id").isNull() | (F.col("page_id") < F.col("head"))
    found = met.withColumn("refers_to", F.when(follows, F.col("head")))
    return found.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def write_bundles(records: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write roles() as bundles at path, in the partitions that the join of roles left."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=3)
        frames: list[tuple[bytes, int]] = []
        index: list[dict] = []
        plain = bytearray()
        stored = 0

        def close() -> None:
            nonlocal plain, stored
            if plain:
                frames.append((press.compress(bytes(plain)), len(plain)))
                stored += len(frames[-1][0])
                plain = bytearray()

        def flush() -> pa.RecordBatch:
            schema = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("index", pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32())])))])
            return pa.RecordBatch.from_pydict({"bundle": [f"{part:06d}-{seq:06d}.warc.zst"], "data": [seal(frames)], "index": [index]}, schema)

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                index.append({"page_id": page_id, "frame": len(frames), "offset": len(plain)})
                plain += record(page_id, url, (html or "").encode(), refers_to, revisit)
                if len(plain) >= frame_bytes:
                    close()
                if stored >= bundle_bytes:
                    yield flush()
                    frames, index, stored, seq = [], [], 0, seq + 1
        close()
        if frames:
            yield flush()

    ordered = records.sortWithinPartitions(F.col("page_id").asc_nulls_first(), "html")
    ordered.mapInArrow(write, _BUNDLE).write.option("compression", "uncompressed").option("parquet.block.size", str(16 << 20)).parquet(path)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, found by its index entry: page_id, payload_bytes, payload_digest, record_type, refers_to, bundle, frame, offset.

    A response's size and digest are taken from its block; a revisit's are those in its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, index in zip(*(batch.column(c).to_pylist() for c in ("bundle", "data", "index")), strict=True):
                table, at, plain = seek_table(data), -1, b""
                rows: list[tuple] = []
                for entry in index:
                    if entry["frame"] != at:
                        at = entry["frame"]
                        plain = open_frame(data, table[at])
                    head, block = parse(plain, entry["offset"])
                    page_id = _page(head["WARC-Record-ID"])
                    if head["WARC-Type"] == "revisit":
                        rows.append((page_id, int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", _page(head["WARC-Refers-To"]), name, at, entry["offset"]))
                    else:
                        rows.append((page_id, len(block), base64.b32encode(hashlib.sha1(block).digest()).decode(), "response", None, name, at, entry["offset"]))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)

    return bundles.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset int")


_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "offset"]


def fetch(bundles: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The payloads of some pages: their index entries by join, then one frame each; a revisit's payload is looked up at its response by a second call."""
    wanted = bundles.select("bundle", F.explode("index").alias("e")).select("bundle", "e.*").join(page_ids.select("page_id").distinct(), "page_id").groupBy("bundle").agg(F.collect_list(F.struct("page_id", "frame", "offset")).alias("wanted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, entries in zip(batch.column("data").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                table = seek_table(data)
                got = [(e["page_id"], *parse(open_frame(data, table[e["frame"]]), e["offset"])) for e in entries]
                yield pa.RecordBatch.from_pydict({"page_id": pa.array([g[0] for g in got], pa.int64()), "record_type": [g[1]["WARC-Type"] for g in got], "payload": pa.array([g[2] for g in got], pa.binary())})

    return bundles.select("bundle", "data").join(wanted, "bundle").select("data", "wanted").mapInArrow(read, "page_id long, record_type string, payload binary")


def archive(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) to bundles in the shared folder; return read_bundles of them."""
    path = fresh_path(pages.sparkSession, "warc")
    write_bundles(roles(pages), path)
    return read_bundles(pages.sparkSession.read.schema(_BUNDLE).parquet(path))
