"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Pieces are counted by size first, so the sorted pieces and the sorted gaps are
runs (size, first rank or sequence, count): at most `capacity` of each however
large the corpus is. A round is one Spark job over the runs. The runs are dealt
by ranges of size; each range sweeps its own two sorted lists, each gap taking
the largest piece left that fits it, and gaps that want one piece being served
by rank. What a range leaves over (gaps without pieces, pieces without gaps)
meets in a second sweep over all ranges. Gaps shrink by what they took; when no
piece fits a gap, as many sequences open as the tokens left fill, with the
largest pieces. The round's runs and matches are written to the shared folder,
from where the next round reads them, until no piece is left. Spark then ranks
the pieces of each size (by blocks, so that one very common size is no hot
group) and looks every piece's (size, rank) up in the matches.

Runs split only at sweeps, at most once for each gap run and piece run, so the
matches are at most 2 * capacity rows a round and are broadcast; rounds follow
capacity, not the number of pieces.

Defined results: a null or empty text is its end id alone, one piece; an empty
table gives no rows; repeated rows are packed each; only (doc_id, text) are
read, so that other columns' names don't matter.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.store import settle, stored
from gavel.llm.tokens import encoder
from gavel.llm.words import blocks

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Encode (doc_id, text), end each text with end_id, and cut what is longer than capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for a, b in blocks(batch.column("text")):
                rows = batch.slice(a, b - a)
                ids, first = enc.encode(rows.column("text"), end_id)
                wide = memoryview(ids.astype("<u4"))
                size = np.diff(first)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                crc = [zlib.crc32(wide[x : x + k]) for x, k in zip((first[doc] + start).tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        settle(forget=False)

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECE)


Run = tuple[int, int, int]  # size, first rank or sequence, count
_STATE = "kind int, size int, first long, count long, sequence long, offset int"
_PIECES, _GAPS, _SHRUNK, _MATCHES = range(4)
#: Ranges of size that sweep by themselves.
RANGES = 8


def sweep(pieces: list[Run], gaps: list[Run], capacity: int) -> tuple[list[Run], list[Run], list[Run], list[tuple[int, int, int, int, int]]]:
    """One pass over sorted runs: each gap takes the largest piece left that fits it.

    Gives the runs left of pieces and of gaps, the shrunk gaps, and the matches (size, first rank, count, first sequence, offset).
    """
    left, at, stack = sorted(pieces), 0, []
    idle, shrunk, matches = [], [], []
    for gap, first, n in sorted(gaps):
        while at < len(left) and left[at][0] <= gap:
            stack.append(left[at])
            at += 1
        while n and stack:
            size, rank, c = stack.pop()
            m = min(n, c)
            matches.append((size, rank, m, first, capacity - gap))
            shrunk.append((gap - size, first, m))
            if c > m:
                stack.append((size, rank + m, c - m))
            first, n = first + m, n - m
        if n:
            idle.append((gap, first, n))
    return stack + left[at:], idle, shrunk, matches


def opened(pieces: list[Run], first: int, capacity: int) -> tuple[list[Run], list[Run], list[tuple[int, int, int, int, int]]]:
    """Open as many sequences as the pieces' tokens fill, or their large pieces need, with the largest pieces: pieces left, gaps, matches."""
    left, gaps, matches = sorted(pieces), [], []
    want = max(-(-sum(s * c for s, _, c in left) // capacity), sum(c for s, _, c in left if 2 * s > capacity))
    while want and left:
        size, rank, c = left.pop()
        m = min(want, c)
        matches.append((size, rank, m, first, 0))
        gaps.append((capacity - size, first, m))
        if c > m:
            left.append((size, rank + m, c - m))
        first, want = first + m, want - m
    return left, gaps, matches


def _runs(table: pa.Table, kind: int) -> list[Run]:
    own = table.filter(pc.equal(table.column("kind"), kind))
    return list(zip(*(own.column(c).to_pylist() for c in ("size", "first", "count")), strict=True))


def _rows(parts: list[tuple[int, list[tuple]]]) -> pa.Table:
    rows = [(kind, *r, *(() if kind == _MATCHES else (None, None))) for kind, runs in parts for r in runs]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * 6, types, strict=True)], ["kind", "size", "first", "count", "sequence", "offset"])


def _sweep_range(capacity: int):
    """A range's own sweep."""

    def run(table: pa.Table) -> pa.Table:
        pieces, gaps, shrunk, matches = sweep(_runs(table, _PIECES), _runs(table, _GAPS), capacity)
        return _rows([(_PIECES, pieces), (_GAPS, gaps), (_SHRUNK, shrunk), (_MATCHES, matches)])

    return run


def _sweep_rest(capacity: int, sequences: int):
    """The sweep over what the ranges left, and new sequences where nothing fits; gaps below all pieces close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        done = table.filter(pc.equal(table.column("kind"), _MATCHES))
        pieces, gaps, shrunk, matches = sweep(_runs(table, _PIECES), _runs(table, _GAPS), capacity)
        gaps += shrunk + _runs(table, _SHRUNK)
        if pieces and not matches and not len(done):
            pieces, fresh, matches = opened(pieces, sequences, capacity)
            gaps += fresh
        least = min((p[0] for p in pieces), default=capacity + 1)
        yield from done.to_batches()
        yield from _rows([(_PIECES, pieces), (_GAPS, [g for g in gaps if g[0] >= least]), (_MATCHES, matches)]).to_batches()

    return run


def matched(counts: DataFrame, capacity: int) -> DataFrame:
    """Matches (size, first, count, sequence, offset) that place counts (size, count) pieces of each size: ranks first.. go to sequences sequence.., one each, at offset."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("sequence", "long"), ("offset", "int"))]
    state = stored(counts.select(F.lit(_PIECES).alias("kind"), F.col("size").cast("int").alias("size"), F.lit(0).cast("long").alias("first"), F.col("count").cast("long").alias("count"), *nothing), "runs")
    rounds, pieces_left, sequences = [], None, 0
    while pieces_left is None or pieces_left:
        ranges = state.where(F.col("kind") < _MATCHES).groupBy(F.floor(F.col("size") * RANGES / (capacity + 1)).alias("range"))
        swept = ranges.applyInArrow(_sweep_range(capacity), _STATE).repartition(1).mapInArrow(_sweep_rest(capacity, sequences), _STATE)
        state = stored(swept, "runs")
        rounds.append(state)
        # The round's table has a few thousand rows at most.
        told = state.agg(F.count(F.when(F.col("kind") == _PIECES, 1)).alias("pieces"), F.max(F.when(F.col("kind") == _MATCHES, F.col("sequence") + F.col("count"))).alias("sequences")).first()
        pieces_left, sequences = told["pieces"], max(sequences, told["sequences"] or 0)
    return functools.reduce(DataFrame.unionByName, rounds).where(F.col("kind") == _MATCHES).select("size", "first", "count", "sequence", "offset")


def ranked(pieces: DataFrame, blocks_each: int) -> DataFrame:
    """pieces with `rank` among those of equal length, from 0: counts by (length, block) summed, then places inside blocks."""
    keyed = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks_each)).cast("int"))
    sums = keyed.groupBy("length", "block").count()
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    placed = keyed.withColumn("at", F.row_number().over(inside) - 1)
    return placed.join(sums, ["length", "block"]).withColumn("rank", F.col("base") + F.col("at")).drop("block", "base", "at")


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give each piece (length of at most capacity) its sequence_id and offset there."""
    spark = pieces.sparkSession
    matches = matched(pieces.groupBy(F.col("length").alias("size")).agg(F.count("*").alias("count")), capacity)
    plan = spark.sparkContext.broadcast(np.array(sorted(map(tuple, matches.collect())), np.int64).reshape(-1, 5))  # at most 2 * capacity rows a round
    names = [f.name for f in pieces.schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, _, sequence, offset = plan.value.T
        key = (size << 44) + first
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(key, (length << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[row] + rank - first[row]), pa.array(offset[row])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked(pieces, int(spark.conf.get("spark.sql.shuffle.partitions"))).select(*names, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Encode, cut and pack docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return assign(stored(cut_pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)
