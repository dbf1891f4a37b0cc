"""Benchmark decontamination by greedy string tiling.

Words are lower-cased and parted at white space and ASCII punctuation. Every
run of `LEAST` words of an item is a seed. Documents find the seeds they share.
Seeds that most items have are not what leads to an item: of each item, the
most frequent seeds that together cover too little of it are set aside, and the
rest are its probes, one of which any contaminated document has. So
for each (document, item) that shares a probe, tiling marks the longest common runs
of unmarked words, each word of either side once: Karp-Rabin hashes of the
current length find matches, the longest are marked first, and the length falls
to `LEAST`. A document is contaminated by an item when tiles cover at least
`COVERAGE` of the item's words, wherever and in whatever order they stand. An item of fewer than
`LEAST` words is found where it is all the words of a line or of a document.

Items travel to the tasks in blocks of at most `BLOCK_WORDS` words, one pass
over the documents for each block, so what is broadcast is bounded and every
item is used.

Defined results: null or empty texts hold no item, and items without words are
in no text; texts of fewer than `LEAST` words share no seed; repeated documents or items give repeated rows; empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.words import Words, blocks, rolled, words

LEAST = 5
COVERAGE = 0.5
BLOCK_WORDS = 2_000_000


def tile(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length) of two sequences of word hashes."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(len(doc), len(item)))
    while True:
        longest, found = length, []
        for a, b in _matches(doc, item, free_doc, free_item, length):
            n = length
            while a + n < len(doc) and b + n < len(item) and free_doc[a + n] and free_item[b + n] and doc[a + n] == item[b + n]:
                n += 1
            longest = max(longest, n)
            found.append((-n, a, b))
        if found and longest > 2 * length:
            length = longest
            continue
        for n, a, b in sorted(found):
            n = -n
            if free_doc[a : a + n].all() and free_item[b : b + n].all():
                free_doc[a : a + n] = free_item[b : b + n] = False
                tiles.append((a, b, n))
        if length == least:
            # What a longer tile cut short may still hold shorter ones.
            if not found:
                return tiles
        else:
            length = max(least, length // 2 if length > 2 * least else least)


def _matches(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Places of equal unmarked runs of `length` words: by rolling hash, then by the words themselves."""
    hd, hi = rolled(doc, length), rolled(item, length)
    open_doc = np.convolve(free_doc, np.ones(length, int), "valid") == length if len(hd) else np.zeros(0, bool)
    open_item = np.convolve(free_item, np.ones(length, int), "valid") == length if len(hi) else np.zeros(0, bool)
    where = defaultdict(list)
    for b in np.flatnonzero(open_item).tolist():
        where[int(hi[b])].append(b)
    if not where:
        return
    likely = np.flatnonzero(open_doc & np.isin(hd, np.fromiter(where, np.uint64, len(where))))
    for a in likely.tolist():
        for b in where[int(hd[a])]:
            if np.array_equal(doc[a : a + length], item[b : b + length]):
                yield a, b


def probes(h: np.ndarray, often: np.ndarray, n_words: int, coverage: float) -> np.ndarray:
    """Seeds of an item without its most frequent ones that together cover too little of it: a document that covers enough has one of the rest."""
    covered, order = np.zeros(n_words, bool), np.argsort(-often, kind="stable")
    for k, p in enumerate(order.tolist()):
        covered[p : p + LEAST] = True
        if covered.sum() >= coverage * n_words:
            return np.unique(h[order[k:]])
    return h[:0]


def seeds(items: list[tuple[int | None, np.ndarray]], coverage: float = COVERAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted seed hashes of all items, and sorted probes with the item each comes from. A stem of many items is no probe unless it covers enough of one."""
    h = [rolled(x, LEAST) for _, x in items]
    none = np.zeros(0, np.uint64)
    seed, often = np.unique(np.concatenate([none, *(np.unique(x) for x in h)]), return_counts=True)
    asked = [probes(x, often[np.searchsorted(seed, x)], len(item), coverage) for x, (_, item) in zip(h, items, strict=True)]
    probe, owner = np.concatenate([none, *asked]), np.repeat(np.arange(len(asked)), [len(x) for x in asked])
    order = np.argsort(probe, kind="stable")
    return seed, probe[order], owner[order]


def _all_from(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one range after another."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _candidates(h: np.ndarray, at: np.ndarray, doc: np.ndarray, held: tuple) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, item, ascending places of the item's seeds) of documents that hold a probe of the item; `at` are the places of all seeds."""
    items, _, probe, owner, _ = held
    for mine in np.split(at, np.flatnonzero(np.diff(doc[at])) + 1):
        order = np.argsort(h[mine], kind="stable")
        values = h[mine][order]
        asked = np.unique(values)
        for k in np.unique(owner[_all_from(np.searchsorted(probe, asked), np.searchsorted(probe, asked, "right"))]).tolist():
            own = np.unique(rolled(items[k][1], LEAST))
            yield int(doc[mine[0]]), k, np.sort(mine[order[_all_from(np.searchsorted(values, own), np.searchsorted(values, own, "right"))]])


def short_items(items: list[tuple[int | None, np.ndarray]]) -> dict[int, dict[bytes, list[int]]]:
    """Items of fewer than `LEAST` words: by length, then by their words' hashes."""
    found: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
    for k, (_, x) in enumerate(items):
        if 0 < len(x) < LEAST:
            found[len(x)][x.tobytes()].append(k)
    return {n: dict(x) for n, x in found.items()}


def _short_found(w: Words, short: dict[int, dict[bytes, list[int]]]) -> list[tuple[int, int]]:
    """(document of the block, item) where a short item is all the words of a line or document."""
    doc, line = w.doc(), np.searchsorted(np.flatnonzero(w.data == 0x0A), w.begin)
    found = set()
    for unit in (doc, line):
        edge = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(unit, prepend=-1))
        size = np.diff(edge, append=len(doc))
        for n, known in short.items():
            at = edge[size == n]
            h = rolled(w.hash, n)
            seed = np.concatenate([rolled(np.frombuffer(x, np.uint64), n) for x in known])
            for p in at[np.isin(h[at], seed)].tolist():
                found.update((int(doc[p]), k) for k in known.get(w.hash[p : p + n].tobytes(), ()))
    return sorted(found)


def _passes(docs: DataFrame, benchmark: DataFrame, coverage: float, block_words: int) -> Iterator:
    """The benchmark's items, in broadcast blocks of bounded size."""
    spark = docs.sparkSession
    n_blocks = 1 + int(benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) // (2 * block_words)  # a word and its space have two characters at least
    for block in range(n_blocks):
        rows = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).toArrow()
        w = words(rows.column("text").combine_chunks() if len(rows) else pa.array([], pa.string()), plain=True)
        items = [(i, w.hash[a:b]) for i, a, b in zip(rows.column("item_id").to_pylist(), w.first[:-1], w.first[1:], strict=True)]
        yield spark.sparkContext.broadcast((items, *seeds(items, coverage), short_items(items)))


def found_in(text: pa.Array, held: tuple, coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(row, item, item's words, covered words, tiles) of the rows of a text column that hold an item."""
    items, seed, _, _, short = held
    out: list[tuple[int, int, int, int, int]] = []
    for a, b in blocks(text) if len(seed) or short else ():
        w = words(text.slice(a, b - a), plain=True)
        if short:
            out += [(a + d, k, len(items[k][1]), len(items[k][1]), 1) for d, k in _short_found(w, short)]
        if not len(seed):
            continue
        h, doc = rolled(w.hash, LEAST), w.doc()
        inside = doc[: len(h)] == doc[LEAST - 1 :] if len(h) else np.zeros(0, bool)
        at = np.searchsorted(seed, h)
        hits = np.flatnonzero(inside & (seed[np.minimum(at, len(seed) - 1)] == h))
        for d, k, where in _candidates(h, hits, doc, held) if len(hits) else ():
            item = items[k][1]
            # Tiles lie inside runs of seed places; runs are kept apart by a word that no item has.
            runs = np.split(where, np.flatnonzero(np.diff(where) > 1) + 1)
            if sum(len(r) + LEAST - 1 for r in runs) < coverage * len(item):
                continue
            tiles = tile(np.concatenate([np.append(w.hash[r[0] : r[-1] + LEAST], np.uint64(0)) for r in runs]), item)
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * len(item):
                out.append((a + d, k, len(item), covered, len(tiles)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, tiles) of each document and the items it holds."""

    def scan(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(batch.column("doc_id")[d].as_py(), held.value[0][k][0], n, c, c / n, t) for d, k, n, c, t in found_in(batch.column("text"), held.value, coverage)]
                cols = zip(*rows, strict=True) if rows else ((),) * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles"])

        return run

    parts = [docs.select("doc_id", "text").mapInArrow(scan(held), "doc_id long, item_id long, item_words long, covered_words long, coverage double, tiles long") for held in _passes(docs, benchmark, coverage, block_words)]
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that hold an item; all columns pass through."""
    at = docs.columns.index("text")

    def keep(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(len(batch), bool)
                stays[[f[0] for f in found_in(batch.column(at), held.value, coverage)]] = False
                yield batch.filter(pa.array(stays))

        return run

    for held in _passes(docs, benchmark, coverage, block_words):
        docs = docs.mapInArrow(keep(held), docs.schema)
    return docs
