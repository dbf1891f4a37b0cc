"""Word splitting and hashing over whole Arrow batches, with numpy.

A word is a maximal run of UTF-8 bytes outside 0x20 and 0x09-0x0D. Its hash is
a 64-bit polynomial over per-byte random constants, finished with a mixer, so
equal words have equal hashes in every task. A batch is handled as one byte
string; documents never share a word.

Defined results: a null or empty text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE32 = np.random.default_rng(20260102).integers(1, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, with ASCII punctuation as spaces.
PLAIN = LOWER.copy()
PLAIN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20

#: Bytes of text handled at once inside a task.
BLOCK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those for a usual block are kept."""
    usual = max(n, 1) <= BLOCK_BYTES + 1
    if usual and int(base) in _POWERS:
        return _POWERS[int(base)][:n]
    out = np.full(BLOCK_BYTES + 1 if usual else n, base, np.uint64)
    out[0] = 1
    out = np.cumprod(out, dtype=np.uint64)
    if usual:
        _POWERS[int(base)] = out
    return out[:n]


@dataclass
class Words:
    """Words of a block of documents, in order.

    data: the block's bytes; begin, end: byte bounds of each word; hash: of each
    word; first: index of each document's first word, with a closing total.
    """

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count())


def blocks(text: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, or of one longer text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
    at = 0
    while at < len(sizes):
        total = np.cumsum(sizes[at:])
        stop = at + max(1, int(np.searchsorted(total, limit, "right")))
        yield at, stop
        at = stop


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after another, and each row's offset with a closing total."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of the words of texts, and the index of each text's first word with a closing total."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[data]
    starts = inside[:n].copy()
    starts[1:] &= ~inside[: n - 1] if n else starts[1:]
    cut = off[(off > 0) & (off < n)]
    starts[cut] = inside[cut]
    begin = np.flatnonzero(starts)
    ends = inside[:n] & ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, off)


def hash_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of bytes from which range_hash takes those of any range."""
    wide, narrow = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint32)
    np.cumsum(_TABLE[data] * powers(_P, len(data)), out=wide[1:])
    np.cumsum(_TABLE32[data] * powers(_P, len(data)).astype(np.uint32), out=narrow[1:])
    return wide, narrow


def range_hash(wide: np.ndarray, narrow: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hash of each range of bytes."""
    back = powers(_P_INV, len(wide))[begin]
    length = (end - begin).astype(np.uint64)
    return mix((wide[end] - wide[begin]) * back + length), (narrow[end] - narrow[begin]) * back.astype(np.uint32) + length.astype(np.uint32)


def words(text: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """Split a text column and hash its words; lower: A-Z count as a-z; plain: ASCII punctuation parts words, too."""
    data, off = text_bytes(text)
    if lower or plain:
        data = (PLAIN if plain else LOWER)[data]
    begin, end, first = word_bounds(data, off)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_P, len(data)), out=total[1:])
    h = mix((total[end] - total[begin]) * powers(_P_INV, len(data))[begin] + (end - begin).astype(np.uint64)) if len(begin) else np.zeros(0, np.uint64)
    return Words(data, begin, end, h, first)


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive values of h; windows may cross documents."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_P, len(h)), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(_P_INV, len(h) - size + 1))


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """Each document's kept words joined by one space, as a string column."""
    chosen = np.flatnonzero(keep)
    doc = w.doc()[chosen]
    lengths = (w.end - w.begin)[chosen] + 1
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    out = np.full(total, 0x20, np.uint8)
    shift = np.repeat(w.begin[chosen] - (stops - lengths), lengths)
    at = np.arange(total)
    body = np.ones(total, bool)
    body[stops - 1] = False
    out[body] = w.data[(at + shift)[body]]
    per = np.zeros(len(w.first) - 1, np.int64)
    np.add.at(per, doc, lengths)
    bounds = np.concatenate([[0], np.cumsum(per)])
    return pa.array([out[a : max(a, b - 1)].tobytes().decode("utf-8") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
