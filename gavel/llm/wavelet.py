"""Token-id output: one wavelet matrix per shard.

Every whole text is encoded, ended with `end_id`, and written in ascending
doc_id order (nulls first, ties by text) as shards of about `SHARD_TOKENS`
ids. A shard is one byte string: the documents' ids and lengths, and sixteen
bit planes (one from each bit of the ids, most significant first, each plane
stably partitioned by the one before). A plane is cut into blocks of
`BLOCK_BITS`, each a Zstandard frame of its own; the file holds a directory of
the frames' ends and of the ones before each block, which is the rank directory
and, searched by halves, the select directory. `WaveletMatrix` answers access,
rank, select, count and occurrence queries from that string alone and opens
only the blocks that a query touches. Spark writes the strings as a Parquet
table in the shared folder, so a lost executor's shards are written again by
the commit protocol.

Defined results: a null or empty text is `end_id` alone; an empty table gives
no shards and no rows; repeated rows are kept; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.store import fresh_path, settle, width
from gavel.llm.tokens import encoder
from gavel.llm.words import blocks

SHARD_TOKENS = 4_000_000
BITS = 16
BLOCK_BITS = 1 << 16
#: Ids of each shard that are also read by access, and one by rank, when it is read back.
_PROBES = 8


class Plane:
    """Bits in blocks, each compressed by itself: frames one after another, their ends, and the ones before each block with a closing total."""

    def __init__(self, n: int, before: np.ndarray, ends: np.ndarray, frames: bytes | memoryview) -> None:
        self.n, self.before, self.ends, self.frames = n, before, ends, frames
        self.zeros = n - int(before[-1])
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def build(cls, ones: np.ndarray) -> Plane:
        packed, press = np.packbits(ones), zstandard.ZstdCompressor(level=1)
        starts = np.arange(0, len(packed), BLOCK_BITS // 8)
        counts = np.add.reduceat(np.bitwise_count(packed), starts, dtype=np.int64) if len(starts) else starts
        frames = [press.compress(packed[a : a + BLOCK_BITS // 8]) for a in starts.tolist()]
        return cls(len(ones), np.append(0, np.cumsum(counts)), np.cumsum([len(f) for f in frames]).astype(np.int64), b"".join(frames))

    def _frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.frames[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])])

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bytes, and the ones in the plane before each byte with a closing total."""
        if k not in self._open:
            raw = np.frombuffer(self._frame(k), np.uint8)
            self._open[k] = raw, self.before[k] + np.append(0, np.cumsum(np.bitwise_count(raw), dtype=np.int64))
        return self._open[k]

    def bits(self) -> np.ndarray:
        """All bits."""
        raw = b"".join([self._frame(k) for k in range(len(self.ends))])
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at positions i (0 at the end), and the ones before them."""
        bit, ones = np.zeros(len(i), np.int64), np.full(len(i), self.before[-1])
        owner = i // BLOCK_BITS
        for k in np.unique(owner[i < self.n]).tolist():
            at = np.flatnonzero((owner == k) & (i < self.n))
            raw, before = self.block(k)
            byte, place = (i[at] - k * BLOCK_BITS) >> 3, (i[at] & 7).astype(np.uint8)
            held = raw[byte]
            bit[at] = (held >> (np.uint8(7) - place)) & 1
            ones[at] = before[byte] + np.bitwise_count((held.astype(np.uint16) >> (8 - place.astype(np.uint16))).astype(np.uint8))
        return bit, ones

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) bits that are value: the block by the directory, then the byte by its counts."""
        edges = np.minimum(np.arange(len(self.before)) * BLOCK_BITS, self.n)
        counts = self.before if value else edges - self.before
        owner, out = np.searchsorted(counts, k, "right") - 1, np.zeros(len(k), np.int64)
        for b in np.unique(owner).tolist():
            at = np.flatnonzero(owner == b)
            raw, before = self.block(b)
            inside = before if value else b * BLOCK_BITS + 8 * np.arange(len(before)) - before
            byte = np.searchsorted(inside, k[at], "right") - 1
            left = k[at] - inside[byte]
            rows = np.unpackbits(raw[byte][:, None], axis=1) == value
            out[at] = b * BLOCK_BITS + 8 * byte + np.argmax(np.cumsum(rows, axis=1) == (left + 1)[:, None], axis=1)
        return out


class WaveletMatrix:
    """A sequence of ids below 2**16 as bit planes with rank and select."""

    def __init__(self, n: int, planes: list[Plane]) -> None:
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        at, planes = np.ascontiguousarray(ids, np.uint16), []
        for b in range(BITS - 1, -1, -1):
            ones = (at & np.uint16(1 << b)).astype(bool)
            planes.append(Plane.build(ones))
            # Arrow filters by bit masks, which is faster than by bytes.
            held = pa.array(at)
            parts = [held.filter(pa.Array.from_buffers(pa.bool_(), len(at), [None, pa.py_buffer(np.packbits(m, bitorder="little"))])) for m in (~ones, ones)]
            at = np.concatenate([p.to_numpy() for p in parts])
        return cls(len(ids), planes)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The ids at positions i."""
        i = np.asarray(i, np.int64)
        out = np.zeros(len(i), np.int64)
        for plane in self.planes:
            bit, ones = plane.get(i)
            i = np.where(bit == 1, plane.zeros + ones, i - ones)
            out = out << 1 | bit
        return out

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        span = np.array([lo, hi], np.int64)
        for level, plane in enumerate(self.planes):
            ones = plane.get(span)[1]
            span = plane.zeros + ones if value >> (BITS - 1 - level) & 1 else span - ones
        return int(span[0]), int(span[1])

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often value stands at positions lo to hi."""
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, value: int, i: int) -> int:
        return self.count(value, 0, i)

    def select(self, value: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th (from 0) occurrences of value."""
        a, b = self._range(value, 0, self.n)
        at = np.asarray(k, np.int64) + a
        if len(at) and (at.min() < a or at.max() >= b):
            raise IndexError("there are fewer occurrences")
        for level in range(BITS - 1, -1, -1):
            plane, one = self.planes[level], value >> (BITS - 1 - level) & 1
            at = plane.select(one, at - plane.zeros if one else at)
        return at

    def occurrences(self, value: int) -> np.ndarray:
        return self.select(value, np.arange(self.count(value)))

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        at = np.zeros(self.n, np.uint16)
        for level in range(BITS - 1, -1, -1):
            plane = self.planes[level]
            ones = plane.bits()
            up = np.empty(self.n, np.uint16)
            up[np.flatnonzero(~ones)] = at[: plane.zeros]
            up[np.flatnonzero(ones)] = at[plane.zeros :] | np.uint16(1 << (BITS - 1 - level))
            at = up
        return at


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The shard file: a head, the planes' directories, documents (id, known or null, length), then the planes' frames."""
    known = np.array([d is not None for d in doc_ids], bool)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    table = zstandard.ZstdCompressor(level=1).compress(docs.tobytes() + known.tobytes() + lengths.astype("<u4").tobytes())
    planes = WaveletMatrix.build(ids).planes
    directory = b"".join([np.concatenate([p.before, p.ends]).astype("<u4").tobytes() for p in planes])
    sizes = [len(table), *[len(p.frames) for p in planes]]
    return struct.pack(f"<4sQQ{len(sizes)}Q", b"GWM2", len(docs), len(ids), *sizes) + directory + table + b"".join([p.frames for p in planes])


def read_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """A shard's documents, their lengths and its wavelet matrix."""
    magic, n_docs, n, *sizes = struct.unpack_from(f"<4sQQ{BITS + 1}Q", blob)
    if magic != b"GWM2":
        raise ValueError("not a wavelet shard")
    head, blocks_each = 20 + 8 * (BITS + 1), -(-n // BLOCK_BITS)
    each = 2 * blocks_each + 1
    directory = np.frombuffer(blob, "<u4", BITS * each, head).astype(np.int64).reshape(BITS, each)
    ends = np.cumsum([head + 4 * BITS * each, *sizes]).tolist()
    table = zstandard.ZstdDecompressor().decompress(blob[ends[0] : ends[1]])
    docs = np.frombuffer(table, "<i8", n_docs)
    known = np.frombuffer(table, bool, n_docs, 8 * n_docs)
    lengths = np.frombuffer(table, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    ids = [d if k else None for d, k in zip(docs.tolist(), known.tolist(), strict=True)]
    view = memoryview(blob)
    return ids, lengths, WaveletMatrix(n, [Plane(n, row[: blocks_each + 1], row[blocks_each + 1 :], view[a:b]) for row, a, b in zip(directory, ends[1:-1], ends[2:], strict=True)])


_SHARD = "part int, seq int, n_docs long, n_tokens long, shard binary"


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode docs (doc_id, text) and write their shards as a table (part, seq, n_docs, n_tokens, shard) at path; (part, seq) is the order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary)
        doc_ids: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = {"part": [part], "seq": [seq], "n_docs": [len(lengths)], "n_tokens": [len(ids)], "shard": [write_shard(doc_ids, lengths, ids)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.binary())]))

        for batch in batches:
            for a, b in blocks(batch.column("text")):
                rows = batch.slice(a, b - a)
                ids, first = enc.encode(rows.column("text"), end_id)
                own, done = rows.column("doc_id").to_pylist(), 0
                while done < len(own):
                    # As many texts as fill the shard.
                    stop = min(len(own), int(np.searchsorted(first, first[done] + shard_tokens - size)))
                    stop = max(stop, done + 1)
                    doc_ids += own[done:stop]
                    held.append((np.diff(first[done : stop + 1]), ids[first[done] : first[stop]]))
                    size += int(first[stop] - first[done])
                    done = stop
                    if size >= shard_tokens:
                        yield flush()
                        doc_ids, held, size, seq = [], [], 0, seq + 1
        if held:
            yield flush()
        doc_ids, held = [], []
        settle(forget=False)

    ordered = docs.select("doc_id", "text").repartitionByRange(width(docs), F.col("doc_id").asc_nulls_first())
    ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(write, _SHARD).write.option("compression", "uncompressed").option("parquet.block.size", str(16 << 20)).parquet(path)


def read_tokens(shards: DataFrame) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens, ids_crc32, and its place (part, seq, at)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "shard")), strict=True):
                doc_ids, lengths, matrix = read_shard(blob)
                ids = matrix.decode()
                at = np.linspace(0, len(ids) - 1, _PROBES).astype(np.int64)
                if (matrix.access(at) != ids[at]).any() or matrix.rank(int(ids[-1]), int(at[1])) != np.count_nonzero(ids[: at[1]] == ids[-1]):
                    raise ValueError("a shard's directory disagrees with its planes")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(crc), pa.int32()), pa.array([seq] * len(crc), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within")).join(parts, "part")
    docs = shards.select("part", "seq", "shard").mapInArrow(read, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "at")


def lookup(shards: DataFrame, token: int) -> DataFrame:
    """Every document of the shards that holds token, with its number of occurrences and the first one's place in the document, by rank and select."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("shard").to_pylist():
                doc_ids, lengths, matrix = read_shard(blob)
                at = matrix.occurrences(token)
                ends = np.cumsum(lengths)
                doc, first, n = np.unique(np.searchsorted(ends, at, "right"), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([doc_ids[d] for d in doc], pa.int64()), pa.array(n, pa.int64()), pa.array(at[first] - (ends - lengths)[doc], pa.int64())], ["doc_id", "n", "first"])

    return shards.select("shard").mapInArrow(find, "doc_id long, n long, first long")


def token_output(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write docs' tokens to shards in the shared folder and return read_tokens of them."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, end_id, path)
    return read_tokens(docs.sparkSession.read.schema(_SHARD).parquet(path))
