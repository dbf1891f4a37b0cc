"""Substring dedup by recompression.

A document's words are named by their hashes. Every round names runs of equal
symbols, then splits names in two halves by a bit of a hash and names each pair
of a left name followed by a right one. A new name is a hash of what it stands
for, so all tasks give equal text the same names without a dictionary. A
symbol's span is the words its making depended on: wherever the span's words
stand again, the same symbol stands there too. So a window holding the span of
a symbol that occurs once in the corpus is itself unique; shared symbols reveal
the rest, which are verified by hashes of the windows' own words (96 bits) and
dated by their first occurrence.

Documents are dealt into chunks by doc_id (null ones by text, as they may be
many). Chunks exchange packed blocks, not rows (see `exchange`): each chunk's
distinct symbols (a name once, however often it occurs there), one answer for
each, then each chunk's distinct suspect windows with their first document, and
again one answer for each. A passage in every document is one entry of each
chunk, so hot passages make no hot task.

Defined results: a null text has no words and stays null, an empty one stays
empty; texts shorter than a window lose nothing; a text that loses nothing
stays as it is; where words are removed the others are joined by one space;
null doc_ids come before all others, in order of a hash of their texts; rows of
one other doc_id are ordered by text; the later of two equal rows loses all its
words; an empty table gives no rows; other columns pass through, except those
named n_words, n_removed or kept_sha256, which are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gavel.llm.exchange import BLOCK, BLOCK_SQL, answered, blocks_of, joined_answers, note
from gavel.llm.store import bits, document_chunk, free_name, settled, settled_pair, unbits, width
from gavel.llm.words import Words, blocks, joined, mix, rolled, words

WINDOW = 20
ROUNDS = 4
_CHUNK = "_chunk_"
_KEPT = 48  # bits of a symbol's name that are exchanged; a clash only makes more windows suspect


def _named(kind: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a + np.uint64(kind)) * np.uint64(3) + mix(b + np.uint64(kind * 7)))


def symbols(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, span from, span to) of the symbols after some rounds; spans that reach out of their document are open (-1 or beyond all words)."""
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    name, owner = h, doc
    begin, end = np.arange(n), np.arange(1, n + 1)  # the words a symbol stands for
    lo, hi = begin, end
    for r in range(rounds):
        # Runs of equal symbols are one symbol. That a run ends depends on the symbol beside it: on its first word, if that
        # differs from the run's own, else on all that the neighbour depends on.
        edge = np.ones(len(name), bool)
        edge[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, len(name)))
        last = first + size - 1
        starts_text = np.append(True, owner[first][1:] != owner[first][:-1])
        ends_text = np.append(starts_text[1:], True)
        differs = h[begin[first] - 1] != h[end[first] - 1]
        new_lo = np.where(starts_text, -1, np.minimum(lo[first], np.where(differs, begin[first] - 1, lo[first - 1])))
        after = np.minimum(last + 1, len(name) - 1)
        differs = h[np.minimum(end[last], n - 1)] != h[begin[last]]
        new_hi = np.where(ends_text, n + 1, np.maximum(hi[last], np.where(differs, end[last] + 1, hi[after])))
        name = np.where(size > 1, _named(10 + r, name[first], size.astype(np.uint64)), name[first])
        owner, begin, end, lo, hi = owner[first], begin[first], end[last], new_lo, new_hi
        left = (mix(name + np.uint64(1000 + r)) & np.uint64(1)).astype(bool)
        m = len(name)
        beside = np.zeros(m, bool)  # the next symbol is of the same document
        beside[:-1] = owner[1:] == owner[:-1]
        merged = beside & left
        merged[:-1] &= ~left[1:]
        merged[-1:] = False
        # Those that stay depend on the neighbour they would have joined.
        new_lo, new_hi = lo.copy(), hi.copy()
        stay_l = left & ~merged
        i = np.flatnonzero(stay_l & beside)
        new_hi[i] = np.maximum(hi[i], hi[i + 1])
        new_lo[i] = np.minimum(lo[i], lo[i + 1])
        new_hi[stay_l & ~beside] = n + 1
        after = np.append(False, beside[:-1])  # the symbol before is of the same document
        taken = np.append(False, merged[:-1])
        stay_r = ~left & ~taken
        i = np.flatnonzero(stay_r & after)
        new_lo[i] = np.minimum(lo[i], lo[i - 1])
        new_hi[i] = np.maximum(new_hi[i], hi[i - 1])
        new_lo[stay_r & ~after] = -1
        i = np.flatnonzero(merged)
        new_lo[i] = np.minimum(lo[i], lo[i + 1])
        new_hi[i] = np.maximum(hi[i], hi[i + 1])
        new_name = name.copy()
        new_name[i] = _named(2, name[i], name[i + 1])
        new_end = end.copy()
        new_end[i] = end[i + 1]
        keep = ~taken
        name, owner, begin, end, lo, hi = new_name[keep], owner[keep], begin[keep], new_end[keep], new_lo[keep], new_hi[keep]
    return name, lo, hi


class Chunk:
    """The documents of one chunk in corpus order, with their words."""

    def __init__(self, table: pa.Table, window: int) -> None:
        ties = [int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little", signed=True) if d is None else 0 for d, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)] if table.column("doc_id").null_count else [0] * len(table)
        keys = pa.table({"doc_id": table.column("doc_id"), "tie": pa.array(ties, pa.int64()), "text": table.column("text")})
        order = pc.sort_indices(keys, [("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")], null_placement="at_start")
        self.table, self.window = table.take(order), window
        self.tie = np.asarray(keys.column("tie").take(order), np.int64)
        text = self.table.column("text").combine_chunks()
        text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
        self.parts = [(a, b) for a, b in blocks(text)]
        self.text = text
        hs, counts = [], []
        for a, b in self.parts:
            w = words(text.slice(a, b - a))
            hs.append(w.hash)
            counts.append(w.count())
        self.h = np.concatenate([np.zeros(0, np.uint64), *hs])
        self.count = np.concatenate([np.zeros(0, np.int64), *counts])
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def words_of(self, part: tuple[int, int]) -> Words:
        return words(self.text.slice(part[0], part[1] - part[0]))

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names (kept bits), spans of symbols that some window can hold; block by block, as symbols keep to their documents."""
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at = 0
        for a, b in self.parts:
            n = int(self.count[a:b].sum())
            doc = self.doc[at : at + n]
            name, lo, hi = symbols(self.h[at : at + n], doc)
            useful = np.flatnonzero((lo >= 0) & (hi <= n) & (hi - lo <= self.window))
            useful = useful[doc[lo[useful]] == doc[hi[useful] - 1]]
            out.append((name[useful] >> np.uint64(64 - _KEPT), lo[useful] + at, hi[useful] + at))
            at += n
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def starts(self) -> np.ndarray:
        """Places where a window of one document starts."""
        n = len(self.h) - self.window + 1
        return np.flatnonzero(self.doc[:n] == self.doc[self.window - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def suspects(self, shared: np.ndarray | None) -> np.ndarray:
        """Window starts that no unique symbol clears; shared: answers for the chunk's distinct names."""
        name, lo, hi = self.names()
        _, at, n = np.unique(name, return_inverse=True, return_counts=True)
        alone = (n[at] == 1) & ~shared[at] if len(name) else np.zeros(0, bool)
        cover = np.zeros(len(self.h) + 2, np.int64)
        np.add.at(cover, np.maximum(hi[alone] - self.window, 0), 1)
        np.add.at(cover, lo[alone] + 1, -1)
        starts = self.starts()
        return starts[np.cumsum(cover)[starts] == 0]

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows among starts, in order of (hash, check): hash, check, first start; and each start's index among them."""
        hash_, check = rolled(self.h, self.window)[starts], rolled(mix(self.h + np.uint64(77)), self.window)[starts] >> np.uint64(32)
        order = np.lexsort((starts, check, hash_))
        h, c = hash_[order], check[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        return h[new], c[new], starts[order][new], index

    def ids(self) -> np.ndarray:
        """doc_ids for comparing; null is the least."""
        return np.asarray(pc.fill_null(self.table.column("doc_id").cast(pa.int64()), np.iinfo(np.int64).min), np.int64)


def dedup(docs: DataFrame, window: int = WINDOW, texts: bool = True, digests: bool = False) -> DataFrame:
    """docs without the words of windows that also start earlier; adds n_words and n_removed, and with digests kept_sha256.

    texts: give the shortened texts (else the column is left out).
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    n = width(docs)
    chunk_column = free_name(docs, _CHUNK)
    base = docs.withColumn(chunk_column, document_chunk(n)).repartition(n, chunk_column)
    columns = docs.columns

    def chunk_id(table: pa.Table) -> int:
        return table.column(chunk_column)[0].as_py()

    def emit_names(table: pa.Table) -> pa.Table:
        return blocks_of(np.unique(Chunk(table, window).names()[0]), [], chunk_id(table), _KEPT)

    def shared(names: np.ndarray, _: list[np.ndarray]) -> np.ndarray:
        """Whether another chunk has a name."""
        _, at, times = np.unique(names, return_inverse=True, return_counts=True)
        return times[at] > 1

    def emit_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return BLOCK.empty_table()
        chunk = Chunk(table, window)
        starts = chunk.suspects(joined_answers(replies).astype(bool))
        hash_, check, first, _ = chunk.windows(starts)
        owner = chunk.doc[first]
        mask = np.zeros(len(chunk.h), bool)
        mask[starts] = True
        own = blocks_of(hash_, [check.astype("<u4"), chunk.ids()[owner].astype("<i8"), chunk.tie[owner].astype("<i8")], chunk_id(table), 64)
        # Which starts were asked for goes along, for the chunk itself.
        return pa.concat_tables([own, note(bits(mask), chunk_id(table))])

    def later(hashes: np.ndarray, sides: list[np.ndarray]) -> np.ndarray:
        """Whether an earlier document of another chunk has a window."""
        check, owner, tie = sides
        order = np.lexsort((tie, owner, check, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (check[order][1:] != check[order][:-1])
        out = np.empty(len(order), bool)
        out[order] = ~new
        return out

    fields = [f for f in docs.schema.fields if texts or f.name != "text"] + [StructField("n_words", LongType()), StructField("n_removed", LongType())] + [StructField("kept_sha256", StringType())] * digests

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        mask = replies.filter(pc.less(replies.column("range"), 0)).column("answers").to_pylist()
        starts = np.flatnonzero(unbits(mask[0])) if mask else np.zeros(0, np.int64)
        _, _, first, index = chunk.windows(starts)
        found = joined_answers(replies).astype(bool)
        repeated = found[index] if len(starts) else np.zeros(0, bool)
        repeated |= starts != first[index]
        cover = np.zeros(len(chunk.h) + 1, np.int64)
        np.add.at(cover, starts[repeated], 1)
        np.add.at(cover, starts[repeated] + window, -1)
        gone = np.cumsum(cover)[: len(chunk.h)] > 0
        lost = np.bincount(chunk.doc[gone], minlength=len(chunk.count)) if len(chunk.doc) else np.zeros(len(chunk.count), np.int64)
        out = chunk.table.select(columns)
        kept: list[pa.Array] = []
        at = 0
        for part in chunk.parts if texts or digests else []:
            w = chunk.words_of(part)
            kept.append(joined(w, ~gone[at : at + len(w.hash)]))
            at += len(w.hash)
        text = pa.chunked_array(kept, pa.string()) if kept else None
        if not texts:
            out = out.drop_columns(["text"])
        elif text is not None:
            i = out.schema.get_field_index("text")
            out = out.set_column(i, out.schema.field(i), pc.if_else(pa.array(lost > 0), text, out.column(i).cast(pa.string())))
        out = out.append_column("n_words", pa.array(chunk.count, pa.int64())).append_column("n_removed", pa.array(lost, pa.int64()))
        if digests:
            out = out.append_column("kept_sha256", pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text.to_pylist()] if text is not None else [], pa.string()))
        return out

    texts_only = base.select("doc_id", "text", chunk_column).groupBy(chunk_column)
    named = answered(texts_only.applyInArrow(settled(emit_names), BLOCK_SQL), n, _KEPT, [], shared)
    asked = texts_only.cogroup(named.groupBy("chunk")).applyInArrow(settled_pair(emit_windows), BLOCK_SQL)
    dated = answered(asked, n, 64, ["<u4", "<i8", "<i8"], later)
    return base.groupBy(chunk_column).cogroup(dated.groupBy("chunk")).applyInArrow(settled_pair(remove), StructType(fields))
