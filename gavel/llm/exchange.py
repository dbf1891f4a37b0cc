"""Questions of all chunks about the same values, answered without a row for each value or for each pair of chunks.

A chunk's ascending distinct 64-bit keys, with small columns beside them, are cut into `FAN` ranges of the key space;
a range's keys travel as one packed block, empty ones not at all. So a chunk sends at most FAN blocks however many
chunks there are. Up to `DIRECT` chunks, a range of all chunks is one group, which answers every key of every block.
Beyond, levels go between: a task takes a range of FAN chunks, cuts it into FAN finer ranges and sends each on as one
bundle; answers come back the same way. Blocks grow in proportion to the chunks, and a group holds at most about
DIRECT blocks of one chunk's size over FAN. A key is in a chunk once, so no value makes a hot group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.store import pack, settled, unpack

FAN_BITS = 6
FAN = 1 << FAN_BITS
#: Chunks whose blocks of one range meet in one group.
DIRECT = 512

#: path: the range, FAN_BITS a level. home: who sent the bundle, and gets its answer. sources, sizes: the chunks whose lists it holds, and the lists' lengths.
_FIELDS = [("path", pa.int64()), ("home", pa.int64()), ("sources", pa.binary()), ("sizes", pa.binary())]
BLOCK = pa.schema([*_FIELDS, ("keys", pa.binary()), ("columns", pa.list_(pa.binary()))])
BLOCK_SQL = "path long, home long, sources binary, sizes binary, keys binary, columns array<binary>"
_ANSWER = pa.schema([*_FIELDS, ("answers", pa.binary())])
_ANSWER_SQL = "path long, home long, sources binary, sizes binary, answers binary"

Lists = tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]  # sources, sizes, keys and columns of lists one after another


def levels(n: int, direct: int = DIRECT) -> int:
    """Levels of ranges for n chunks."""
    k = 1
    while n > direct:
        n, k = -(-n // FAN), k + 1
    return k


def _gaps(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    gaps = np.diff(keys, prepend=np.uint64(0))
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    gaps[first] = keys[first]
    return gaps


def _from_gaps(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps, dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    before = np.where(first > 0, total[np.maximum(first - 1, 0)], np.uint64(0)) if len(total) else np.zeros(len(sizes), np.uint64)
    return total - np.repeat(before, sizes)


def _row(path: int, home: int, lists: Lists) -> tuple:
    sources, sizes, keys, columns = lists
    return path, home, sources.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), pack(_gaps(keys, sizes)), [pack(c) for c in columns]


def _cut(lists: Lists, low_bit: int) -> list[tuple[int, Lists]]:
    """Lists by FAN_BITS of their keys from low_bit up; empty ones are left out."""
    sources, sizes, keys, columns = lists
    digit = (keys >> np.uint64(low_bit)).astype(np.int64) & (FAN - 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((owner, digit)) if len(sizes) > 1 else np.arange(len(keys))
    ends = np.searchsorted(digit[order], np.arange(FAN + 1))
    out = []
    for d in range(FAN):
        at = order[ends[d] : ends[d + 1]]
        if len(at):
            count = np.bincount(owner[at], minlength=len(sizes))
            some = count > 0
            out.append((d, (sources[some], count[some], keys[at], [c[at] for c in columns])))
    return out


def blocks_of(keys: np.ndarray, columns: list[np.ndarray], chunk: int, bits: int) -> pa.Table:
    """A chunk's blocks; keys ascend and have `bits` bits."""
    rows = [_row(d, chunk, lists) for d, lists in _cut((np.array([chunk]), np.array([len(keys)]), keys.astype(np.uint64), columns), bits - FAN_BITS)]
    return _table(rows, BLOCK)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((),) * len(schema), schema, strict=True)], schema=schema)


def _read(table: pa.Table, kinds: list[str]) -> tuple[list[tuple[int, int, int]], Lists]:
    """A group's bundles as (path, home, number of lists), and all their lists together."""
    heads, parts = [], []
    for path, home, sources, sizes, keys, columns in zip(*(table.column(c).to_pylist() for c in BLOCK.names), strict=True):
        size = np.frombuffer(sizes, "<i8")
        heads.append((path, home, len(size)))
        parts.append((np.frombuffer(sources, "<i8"), size, _from_gaps(unpack(keys, "<u8"), size), [unpack(c, k) for c, k in zip(columns, kinds, strict=True)]))
    sources, sizes, keys = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return heads, (sources, sizes, keys, [np.concatenate([p[3][k] for p in parts]) for k in range(len(kinds))])


def answered(blocks: DataFrame, n: int, bits: int, kinds: list[str], answer: Callable[[np.ndarray, list[np.ndarray]], np.ndarray], direct: int = DIRECT, reply: str = "u1") -> DataFrame:
    """(chunk, range, answers): for each block of n chunks, one number of dtype `reply` for each of its keys.

    Rows of a negative path are a chunk's notes to itself: they come back with that range, and with `sources` as answers.

    answer gets all blocks' keys of a range, not in order, and the columns beside them (of dtypes `kinds`), and gives one number for each.
    """
    depth = levels(n, direct)

    def split(level: int):
        def run(table: pa.Table) -> pa.Table:
            if _notes(table):
                return table.select(BLOCK.names)
            heads, lists = _read(table, kinds)
            return _table([_row(heads[0][0] << FAN_BITS | d, heads[0][1] >> FAN_BITS, part) for d, part in _cut(lists, bits - FAN_BITS * (level + 1))], BLOCK)

        return run

    def resolve(table: pa.Table) -> pa.Table:
        if _notes(table):
            return pa.Table.from_arrays([table.column(c) for c in ("path", "home", "sources", "sizes", "sources")], schema=_ANSWER)
        heads, (sources, sizes, keys, columns) = _read(table, kinds)
        got = answer(keys, columns).astype(reply)
        ends, rows, at = np.append(0, np.cumsum(sizes)), [], 0
        for path, home, k in heads:
            rows.append((path, home, sources[at : at + k].tobytes(), sizes[at : at + k].tobytes(), pack(got[ends[at] : ends[at + k]])))
            at += k
        return _table(rows, _ANSWER)

    def join(level: int):
        """Answers of finer ranges as those of the bundles that were cut."""

        def run(table: pa.Table) -> pa.Table:
            if _notes(table):
                return table.select(_ANSWER.names)
            held: dict[int, list[tuple[int, np.ndarray]]] = {}
            path = table.column("path")[0].as_py() >> FAN_BITS
            for fine, sources, sizes, got in zip(*(table.column(c).to_pylist() for c in ("path", "sources", "sizes", "answers")), strict=True):
                size = np.frombuffer(sizes, "<i8")
                for source, part in zip(np.frombuffer(sources, "<i8").tolist(), np.split(unpack(got, reply), np.cumsum(size)[:-1]), strict=True):
                    held.setdefault(source, []).append((fine, part))
            homes: dict[int, list[int]] = {}
            for source in sorted(held):
                homes.setdefault(source >> FAN_BITS * (level - 1), []).append(source)
            rows = []
            for home, sources in homes.items():
                lists = [np.concatenate([p for _, p in sorted(held[s], key=lambda x: x[0])]) for s in sources]
                rows.append((path, home, np.array(sources, "<i8").tobytes(), np.array([len(x) for x in lists], "<i8").tobytes(), pack(np.concatenate(lists))))
            return _table(rows, _ANSWER)

        return run

    for level in range(1, depth):
        blocks = blocks.groupBy("path", F.shiftright("home", FAN_BITS).alias("_sender")).applyInArrow(settled(split(level)), BLOCK_SQL)
    got = blocks.groupBy("path").applyInArrow(settled(resolve), _ANSWER_SQL)
    for level in range(depth - 1, 0, -1):
        got = got.groupBy(F.when(F.col("path") < 0, F.col("path")).otherwise(F.shiftright("path", FAN_BITS)).alias("_cut"), "home").applyInArrow(settled(join(level)), _ANSWER_SQL)
    return got.select(F.col("home").cast("int").alias("chunk"), F.col("path").cast("int").alias("range"), "answers")


def note(text: bytes, chunk: int) -> pa.Table:
    """A chunk's note to itself; each chunk's has a path, and so a group, of its own."""
    return _table([(-1 - chunk, chunk, text, b"", b"", [])], BLOCK)


def _notes(table: pa.Table) -> bool:
    return table.column("path")[0].as_py() < 0


def joined_answers(replies: pa.Table, reply: str = "u1") -> np.ndarray:
    """A chunk's answers in the order of its keys, without its notes."""
    replies = replies.filter(pc.greater_equal(replies.column("range"), 0))
    got = sorted(zip(replies.column("range").to_pylist(), replies.column("answers").to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, reply), *[unpack(a, reply) for _, a in got]])
