"""Alignment of two tokenizers' tokens over whole texts, in Arrow inside tasks and merged by Spark.

Both tokenizers encode space + text: A byte-level (`tokenizers`), B by pieces
(`sentencepiece`, which adds the space itself). In a task a block of texts is
two list columns of ids. They are flattened with their parent indices; the
tokens' byte lengths, summed up by segments, give the place in its document
where each token ends; an Acero hash join on (document, end) finds the ends
that A and B share. These cut the tokens into groups, and the tokens that end
there are the links. Links are counted by Table.group_by, by document and over
units of about `UNIT_BYTES` of text; Spark adds the units' partial counts up,
takes each B id's highest, and joins them back to the units' pairs, so that a
pair is one row of a unit however often it occurs. A unit keeps its documents'
links as places in its ascending pairs, where they find the counts again.

sentencepiece is asked for units of text only (a run of spaces and what stands
behind it), each once while a worker keeps it. That gives the ids of the whole
text, as no piece of the vocabulary holds a space behind another character;
other vocabularies are refused.

Defined results: null and empty texts and those whose joined token bytes differ
from space + text (U+2581 is a space to B) have no tokens: zeros and an empty
groups_sha256; strings that look like special tokens are ordinary text; rows of
one doc_id are rows of their own and all count; an empty table gives no rows;
only (doc_id, text) are read, so that other columns' names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.store import pack, settle, settled_pair, stored, unpack
from gavel.llm.tokens import Encoder, encoder
from gavel.llm.words import blocks, text_bytes

#: Text whose links are counted together before Spark sees them.
UNIT_BYTES = 6 << 20
#: Bytes of units of text, and number of them, whose pieces a worker keeps.
_KEEP_BYTES, _KEEP_UNITS = 8 << 20, 200_000
_MARK = "▁"
_COMMA, _BAR, _SEMICOLON = (pa.scalar(x, pa.large_string()) for x in ",|;")
_ID_BITS = 16

#: Rows of documents (at from 0) and of units (at -1): what a unit's documents link, its pairs, and how often it links them.
_FIELDS = [("unit", "long"), ("at", "long"), ("doc_id", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string"), ("links", "binary"), ("pairs", "array<long>"), ("times", "array<long>")]
_ROWS = ", ".join(" ".join(f) for f in _FIELDS)
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(c, _ARROW[t]) for c, t in _FIELDS])


def byte_level_bytes(enc: Encoder) -> pa.Array:
    """The bytes of each id of a byte-level vocabulary."""
    # Bytes that are printable stand for themselves, the others, in order, for the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
    special = {t.content for t in enc.plain.get_added_tokens_decoder().values()}
    out = [b""] * enc.plain.get_vocab_size()
    for token, i in enc.plain.get_vocab().items():
        out[i] = token.encode() if token in special else bytes(of[c] for c in token)
    return pa.array(out, pa.large_binary())


class Pieces:
    """Ids of texts by a sentencepiece model, for space + text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        if size > 1 << _ID_BITS or any(_MARK in p.lstrip(_MARK) for p in pieces):
            raise ValueError("this vocabulary has ids of over 16 bits or pieces with a space behind other characters")
        self.bytes = pa.array([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        self.space = self.model.piece_to_id(_MARK)
        self._forget()

    def _forget(self) -> None:
        self.units = pa.array([], pa.large_binary())
        self.lists = pa.array([], pa.large_list(pa.uint16()))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Flat ids of texts that begin with their space, and each text's first with a closing total."""
        if self.units.nbytes > _KEEP_BYTES or len(self.units) > _KEEP_UNITS:
            self._forget()
        space = data == 0x20
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[off[:-1]] = True
        begin = np.append(np.flatnonzero(starts), len(data))
        units = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(data)])
        at = pc.index_in(units, value_set=self.units)
        if at.null_count:
            new = pc.is_null(at)
            missed = units.filter(new)
            fresh = pc.unique(missed)
            at = pc.replace_with_mask(at, new, pc.add(pc.index_in(missed, value_set=fresh), pa.scalar(len(self.units), pa.int32())))
            # The model adds one space itself; a space alone would be nothing to it.
            ids = self.model.encode([u[1:].decode() for u in fresh.to_pylist()], num_threads=1)
            lists = pa.array([i if i else [self.space] for i in ids], pa.large_list(pa.uint16()))
            self.units, self.lists = pa.concat_arrays([self.units, fresh]), pa.concat_arrays([self.lists, lists])
        found = self.lists.take(at)
        total = np.append(0, np.cumsum(np.asarray(pc.list_value_length(found))))
        return found.flatten(), total[np.searchsorted(begin, off)]


_LOADED: dict[tuple[str, str], tuple[Encoder, pa.Array, Pieces, pa.Array]] = {}


def _loaded(a_path: str, b_path: str) -> tuple[Encoder, pa.Array, Pieces, pa.Array]:
    """A's encoder, the bytes of its ids, B's pieces, and ids as decimal text."""
    if (a_path, b_path) not in _LOADED:
        enc = encoder(a_path)
        _LOADED[a_path, b_path] = enc, byte_level_bytes(enc), Pieces(b_path), pa.array(range(1 << _ID_BITS)).cast(pa.large_string())
    return _LOADED[a_path, b_path]


def _joined(vocabulary: pa.Array, ids: pa.Array) -> np.ndarray:
    """The bytes of tokens one after another."""
    out = vocabulary.take(ids)
    data = out.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _same(own: np.ndarray, off: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts, data[at], equal own[off]."""
    if len(own) == len(data) and np.array_equal(off, at) and np.array_equal(own, data):
        return np.ones(len(off) - 1, bool)
    x, y = memoryview(own), memoryview(data)
    return np.array([x[a:b] == y[c:d] for a, b, c, d in zip(off[:-1].tolist(), off[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)], bool)


def _ends(lists: pa.Array, size_of: pa.Array) -> pa.Table:
    """(doc, end, at, id) of the flattened tokens: end is the segmented cumulative sum of their lengths."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(size_of.take(ids))
    first = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
    sums = np.append(0, np.asarray(total))
    return pa.table({"doc": doc, "end": pc.subtract(total, pa.array(sums[first]).take(doc)), "at": pa.array(np.arange(len(ids))), "id": ids})


def aligned(text: pa.Array, a_path: str, b_path: str) -> tuple[pa.Table, pa.Table]:
    """A block of texts as (n_a, n_b, n_groups, n_links, groups_sha256), a row each, and (doc, pair) of the links; pair: the B id, then 16 bits of the A id."""
    enc, a_bytes, pieces, decimal = _loaded(a_path, b_path)
    data, off = text_bytes(text)
    data, off = np.insert(data, off[:-1], np.uint8(0x20)), off + np.arange(len(off))
    spaced = pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
    a_ids, a_first = enc.encode(spaced)
    a_ids = pa.array(a_ids)
    b_ids, b_first = pieces.encode(data, off)
    whole = np.diff(off) > 1
    sizes = []
    for vocabulary, ids, first in ((a_bytes, a_ids, a_first), (pieces.bytes, b_ids, b_first)):
        sizes.append(pc.binary_length(vocabulary))
        ends = np.append(0, np.cumsum(np.asarray(sizes[-1].take(ids))))
        whole &= _same(data, off, _joined(vocabulary, ids), ends[first])
    keep = pa.array(whole)
    lists = [pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), ids).filter(keep) for ids, first in ((a_ids, a_first), (b_ids, b_first))]
    a, b = (_ends(x, size) for x, size in zip(lists, sizes, strict=True))
    met = a.join(b, ["doc", "end"], join_type="inner", left_suffix="_a", right_suffix="_b", use_threads=False).combine_chunks()
    met = met.take(pc.sort_indices(met, sort_keys=[("at_a", "ascending")]))

    def groups(table: pa.Table, at: str) -> pa.Array:
        """The ids of each group, joined by commas: groups end where both tokenizers' tokens do."""
        digits = decimal.take(table.column("id").combine_chunks())
        cuts = pa.array(np.append(0, np.asarray(met.column(at)) + 1))
        return pc.binary_join(pa.LargeListArray.from_arrays(cuts, digits), _COMMA)

    texts = pc.binary_join_element_wise(groups(a, "at_a"), groups(b, "at_b"), _BAR)
    n = int(whole.sum())
    each = np.bincount(np.asarray(met.column("doc")), minlength=n)
    by_doc = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(each))), texts), _SEMICOLON)
    row = np.flatnonzero(whole)
    out = {c: np.zeros(len(text), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    for c, x in (("n_a", np.diff(a_first)[row]), ("n_b", np.diff(b_first)[row]), ("n_groups", each), ("n_links", each)):
        out[c][row] = x
    sha = np.full(len(text), "", object)
    sha[row] = [hashlib.sha256(s.as_buffer()).hexdigest() for s in by_doc]
    wide = lambda c: met.column(c).cast(pa.int64())
    pair = pc.bit_wise_or(pc.shift_left(wide("id_b"), _ID_BITS), wide("id_a"))
    return pa.table(out | {"groups_sha256": pa.array(sha, pa.string())}), pa.table({"doc": pa.array(row).take(met.column("doc").combine_chunks()), "pair": pair.combine_chunks()})


def _unit_row(unit: int, n_docs: int, held: list[pa.Table]) -> pa.RecordBatch:
    """A unit's row from its documents' partial counts (at, pair, times)."""
    links = pa.concat_tables(held)
    counts = links.group_by("pair", use_threads=False).aggregate([("times", "sum")]).sort_by("pair")
    pairs = counts.column("pair").to_numpy()
    doc, place, times = links.column("at").to_numpy(), np.searchsorted(pairs, links.column("pair").to_numpy()), links.column("times").to_numpy()
    order = np.lexsort((place, doc))
    sizes = np.bincount(doc, minlength=n_docs)
    parts = [pack(sizes.astype("<u4")), pack(np.diff(place[order], prepend=0).astype("<i4")), pack(times[order].astype("<u4"))]
    head = np.array([len(x) for x in parts[:2]], "<i8").tobytes()
    row = {c: None for c in _SCHEMA.names} | {"unit": unit, "at": -1, "links": head + b"".join(parts), "pairs": pairs, "times": counts.column("times_sum").to_numpy()}
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row.values(), _SCHEMA, strict=True)], schema=_SCHEMA)


def _unit_links(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document, the place among the unit's pairs, and the number of each document's links."""
    a, b = np.cumsum(np.frombuffer(blob, "<i8", 2)) + 16
    sizes, gaps, times = unpack(blob[16:a], "<u4"), unpack(blob[a:b], "<i4"), unpack(blob[b:], "<u4")
    return np.repeat(np.arange(len(sizes)), sizes), np.cumsum(gaps, dtype=np.int64), times.astype(np.int64)


def documents_and_units(docs: DataFrame, a_path: str, b_path: str, unit_bytes: int | None = None) -> DataFrame:
    """A row for each document, and one for each unit of documents with its links and partial counts."""
    limit = unit_bytes or UNIT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        unit, size, n, held = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            for x, y in blocks(batch.column("text")):
                part = batch.slice(x, y - x)
                rows, links = aligned(part.column("text"), a_path, b_path)
                counts = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
                at = np.arange(n, n + len(part))
                held.append(pa.table({"at": pc.add(counts.column("doc"), n), "pair": counts.column("pair"), "times": counts.column("count_all")}))
                none = [pa.nulls(len(part), f.type) for f in _SCHEMA][-3:]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), unit)), pa.array(at), part.column("doc_id").cast(pa.int64()), *(rows.column(c).combine_chunks() for c in rows.column_names), *none], schema=_SCHEMA)
                size, n = size + part.column("text").nbytes, n + len(part)
                if size >= limit:
                    yield _unit_row(unit, n, held)
                    unit, size, n, held = unit + 1, 0, 0, []
                    settle(forget=False)
        if held:
            yield _unit_row(unit, n, held)
        held.clear()
        _LOADED.clear()
        settle()

    return docs.select("doc_id", "text").mapInArrow(run, _ROWS)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, times, best): corpus-wide counts of (pair, times), and whether it is the highest of the pair's B id."""
    b_id = Window.partitionBy(F.shiftright("pair", _ID_BITS))  # at most as many rows as A has ids
    total = parts.groupBy("pair").agg(F.sum("times").alias("times"))
    return total.select("pair", "times", (F.col("times") == F.max("times").over(b_id)).alias("best"))


def _score(rows: pa.Table, known: pa.Table) -> pa.Table:
    """A unit's documents with n_best and count_sum, from the corpus-wide counts of its pairs."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    docs = rows.filter(pc.greater_equal(rows.column("at"), 0)).sort_by("at")
    blob = rows.filter(pc.less(rows.column("at"), 0)).column("links")[0].as_py()
    doc, place, times = _unit_links(blob)
    known = known.sort_by("pair")
    count, best = known.column("times").to_numpy(), known.column("best").to_numpy()
    sums = [np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)]
    for out, x in zip(sums, (best[place] * times, count[place] * times), strict=True):
        np.add.at(out, doc, x)
    return pa.table([*(docs.column(c) for c in names), *map(pa.array, sums)], [*names, "n_best", "count_sum"])


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    rows = stored(documents_and_units(docs, a_path, b_path), "aligned", compression="zstd")
    parts = rows.where("at < 0").select("unit", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("unit", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    known = parts.select(F.col("unit").alias("of"), "pair").join(stored(pair_counts(parts), "pairs"), "pair")
    scored = rows.drop("pairs", "times").groupBy("unit").cogroup(known.groupBy("of")).applyInArrow(settled_pair(_score), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
