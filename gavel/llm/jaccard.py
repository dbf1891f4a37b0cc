"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the groups its links make.

A document's set is its distinct word shingles. Two documents link when their
sets' intersection is at least `similar` percent of their union. Equal sets are
one node. Then:

1. Inverted list lengths. Chunks exchange packed blocks of their distinct
   shingles and their numbers (see `exchange`); each gets back every shingle's
   class: alone, or how long its list is, by powers of eight.
2. T-occurrence bound. A set must share T = ceil(similar * n) of its n
   shingles with any partner, so one with fewer than T shared shingles has
   none. Of the others, in the order of list classes, all lists but the T - 1
   longest are its short ones (DivideSkip): a partner stands in one of them.
3. Merge of the short lists. Every list is met at the node of its smallest doc_id, its head;
   a set's lists are merged by head, which counts how often each head occurs.
   As all sets use one order of lists, the intersection is at most that count
   (with those of smaller heads, whose lists may hold the head, too) and the
   longer of the two rests; heads that can't reach the required overlap go.
   For the others the count goes on: the lists not met at the head, long ones
   included, are probed by binary search until the overlap is known.
4. Links make groups. Lists that still hold several groups are searched whole,
   in blocks: pairs of different groups that sizes and parity bitmaps (a lower
   bound of the symmetric difference) do not rule out are counted over all
   lists that they share; those whose count and longer rest reach the overlap
   are probed likewise.

Nothing is capped: a pair is left out only if a bound proves that it cannot
link or it is in one group already.

Defined results: null and empty texts and texts without words have an empty
set and link with nothing; fewer words than a shingle has are one shingle;
rows of one doc_id that have words are one document, linked by any of
its texts; null doc_ids
are one document that is larger than all others, and its component is null
if it has no smaller member; an empty table gives no rows; only
(doc_id, text) are read, so that other columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.components import components, labelled
from gavel.llm.exchange import BLOCK, BLOCK_SQL, answered, blocks_of, joined_answers
from gavel.llm.store import document_chunk, settle, settled_pair, stored, width
from gavel.llm.words import blocks, rolled, words

_CHUNK = "_chunk_"
_KEPT = 48  # bits of a shingle that list lengths are counted by; a clash only makes a list look longer
_NULL = (1 << 63) - 1
#: Lower ends of the classes of list lengths above "alone": the longer a list, the later it stands in a set, however long lists get.
CLASSES = (2, *(8**k + 1 for k in range(1, 12)))
#: Documents of one chunk that a list's length counts at most; the order of lists is the same for all sets with or without it.
_MOST = (1 << 16) - 1
BITMAP_WORDS = 16
BLOCK_DOCS = 1_000


def shingle_sets(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending, one after another; and each row's first, with a closing total."""
    text = table.column("text")
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
    sets, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in blocks(text):
        w = words(text.slice(a, b - a), lower=True)
        n = w.count()
        doc = w.doc()
        h = rolled(w.hash, size)
        inside = doc[: len(h)] == doc[size - 1 :] if len(h) else np.zeros(0, bool)
        h, d = h[inside], doc[: len(h)][inside]
        few = np.flatnonzero((n > 0) & (n < size))
        short = np.array([rolled(w.hash[w.first[i] : w.first[i + 1]], int(n[i]))[0] for i in few], np.uint64)
        h, d = np.concatenate([h, short]), np.concatenate([d, few])
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        sets.append(h[new])
        sizes.append(np.bincount(d[new], minlength=b - a))
    return np.concatenate(sets), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def set_signatures(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each set, by different functions of its members."""
    out = []
    for k in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        x = (sets ^ (sets >> np.uint64(29))) * k
        total = np.concatenate([[np.uint64(0)], np.cumsum(x ^ (x >> np.uint64(32)), dtype=np.uint64)])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _need(n: np.ndarray, similar: int) -> np.ndarray:
    return -(-similar * n // 100)


def overlap_needed(n: np.ndarray, m: np.ndarray, similar: int) -> np.ndarray:
    """The least intersection of linked sets of n and m members."""
    return -(-similar * (n + m) // (100 + similar))


def _merge(similar: int):
    """A set's short lists merged by head: the heads that the T-occurrence bound keeps, with the count so far and the tokens left to probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int32()), ("merged", pa.int32()), ("rest", pa.binary())])
        for batch in batches:
            out: list[tuple] = []
            for node, n, short, raw, entries in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "short", "tokens", "entries")), strict=True):
                tokens = np.frombuffer(raw, "<i8")
                token, head, owner, size, rest = (np.array([e[k] for e in entries], np.int64) for k in ("token", "b", "owner", "m", "long"))
                heads, at, merged = np.unique(head, return_index=True, return_counts=True)
                order = np.lexsort((heads, owner[at]))
                heads, at, merged = heads[order], at[order], merged[order]
                size, rest = size[at], rest[at]
                need = overlap_needed(np.int64(n), size, similar)
                most = np.cumsum(merged) + np.maximum(rest, len(tokens) - short)
                fits = (most >= need) & (100 * np.minimum(size, n) >= similar * np.maximum(size, n))
                for k in np.flatnonzero(fits).tolist():
                    left = tokens[~np.isin(tokens, token[head == heads[k]])]
                    if merged[k] + len(left) >= need[k]:
                        out.append((node, int(heads[k]), int(need[k]), int(merged[k]), left.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ((),) * 5, schema, strict=True)], schema=schema)

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose count, with the rest of one set probed in the other, reaches what they need."""
    last, held = None, np.zeros(0, np.int64)
    for batch in batches:
        keep = np.zeros(len(batch), bool)
        need, merged, b = (batch.column(c).to_numpy() for c in ("need", "merged", "b"))
        rest, other = batch.column("rest"), batch.column("y")
        for i in range(len(batch)):
            if b[i] != last:
                last, held = b[i], np.sort(np.frombuffer(other[i].as_buffer(), "<i8"))
            x = np.frombuffer(rest[i].as_buffer(), "<i8")
            at = np.searchsorted(held, x)
            keep[i] = len(held) > 0 and merged[i] + np.count_nonzero(held[np.minimum(at, len(held) - 1)] == x) >= need[i]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def probed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, need, merged, rest) that link."""
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(y, "b").select("a", "b", "need", "merged", "rest", "y").mapInArrow(_probe, "a long, b long")


def candidate_sets(docs: DataFrame, rows: DataFrame, size: int, similar: int, n: int) -> DataFrame:
    """(node, doc, n, short, tokens): sets with T shared shingles; tokens: those shared, shorter lists first; short: how many lists to merge.

    docs: (doc_id, text, _chunk_) dealt by chunk. rows: (node, doc, sig1, sig2, chunk) of the documents that stand for their sets.
    """

    def chosen(table: pa.Table, own: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sets of the standing documents, each once: nodes, doc_ids, shingles, firsts."""
        sets, first = shingle_sets(table, size)
        s1, s2 = set_signatures(sets, first)
        ids = np.asarray(pc.fill_null(table.column("doc_id").cast(pa.int64()), _NULL), np.int64)
        wanted = dict(zip(zip(*(own.column(c).to_pylist() for c in ("doc", "sig1", "sig2")), strict=True), own.column("node").to_pylist(), strict=True))
        keep, nodes = np.zeros(len(ids), bool), []
        for i, key in enumerate(zip(ids.tolist(), s1.tolist(), s2.tolist(), strict=True)):
            if first[i + 1] > first[i] and key in wanted:
                nodes.append(wanted.pop(key))
                keep[i] = True
        sizes = np.diff(first)
        inside = np.repeat(keep, sizes)
        return np.array(nodes, np.int64), ids[keep], sets[inside], np.concatenate([[0], np.cumsum(sizes[keep])]).astype(np.int64)

    def emit(table: pa.Table, own: pa.Table) -> pa.Table:
        if not len(table):
            return BLOCK.empty_table()
        _, _, sets, _ = chosen(table, own)
        name, times = np.unique(sets >> np.uint64(64 - _KEPT), return_counts=True)
        return blocks_of(name, [np.minimum(times, _MOST).astype("<u2")], table.column(_CHUNK)[0].as_py(), _KEPT)

    def classify(names: np.ndarray, times: list[np.ndarray]) -> np.ndarray:
        value, at = np.unique(names, return_inverse=True)
        return np.digitize(np.bincount(at, times[0], len(value)), CLASSES)[at]

    def choose(table: pa.Table, own: pa.Table) -> pa.Table:
        schema = pa.schema([("node", pa.int64()), ("doc", pa.int64()), ("n", pa.int32()), ("short", pa.int32()), ("tokens", pa.binary())])
        if not len(table):
            return schema.empty_table()
        nodes, ids, sets, first = chosen(table, own.filter(pc.is_valid(own.column("node"))))
        classes = joined_answers(own.filter(pc.is_valid(own.column("answers"))))
        cls = classes[np.unique(sets >> np.uint64(64 - _KEPT), return_inverse=True)[1]] if len(sets) else classes
        sizes = np.diff(first)
        alone = np.concatenate([[0], np.cumsum(cls == 0)])
        alone = alone[first[1:]] - alone[first[:-1]]
        need = _need(sizes, similar)
        rows = []
        for i in np.flatnonzero(sizes - alone >= need).tolist():
            s, c = sets[first[i] : first[i + 1]], cls[first[i] : first[i + 1]]
            shared = s[c > 0][np.argsort(c[c > 0], kind="stable")]
            rows.append((int(nodes[i]), int(ids[i]), int(sizes[i]), int(sizes[i] - need[i] + 1 - alone[i]), shared.astype("<u8").tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((),) * 5, schema, strict=True)], schema=schema)

    blocks = docs.groupBy(_CHUNK).cogroup(rows.groupBy("chunk")).applyInArrow(settled_pair(emit), BLOCK_SQL)
    both = answered(blocks, n, _KEPT, ["<u2"], classify).unionByName(rows, allowMissingColumns=True)
    return docs.groupBy(_CHUNK).cogroup(both.groupBy("chunk")).applyInArrow(settled_pair(choose), "node long, doc long, n int, short int, tokens binary")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the short lists; long: how many shared tokens of the set are not among them."""
    for batch in batches:
        short = batch.column("short").to_numpy()
        tokens = [np.frombuffer(t.as_buffer(), "<i8", int(k)) for t, k in zip(batch.column("tokens"), short, strict=True)]
        rest = np.asarray(pc.binary_length(batch.column("tokens"))) // 8 - short
        wide = lambda x: pa.array(np.repeat(x, short))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "<i8"), *tokens])), wide(batch.column("node").to_numpy()), wide(batch.column("doc").to_numpy()), wide(batch.column("n").to_numpy()), wide(rest.astype(np.int32))], ["token", "node", "doc", "n", "long"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, alone = [], []
        for n, t in zip(batch.column("n").to_pylist(), batch.column("tokens"), strict=True):
            x = np.frombuffer(t.as_buffer(), "<u8")
            odd = np.bincount((x % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
            maps.append(np.packbits(odd.astype(bool)).tobytes())
            alone.append(n - len(x))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(alone, pa.int32()), pa.array(maps, pa.binary())], ["node", "alone", "bitmap"])


def _search(similar: int):
    """Pairs of different groups in one block pair of a list that bounds do not rule out; least: how many short lists they must share."""

    def run(table: pa.Table) -> pa.Table:
        node, n, label, rest, alone, side, own = (table.column(c).to_numpy() for c in ("node", "n", "label", "long", "alone", "side", "own"))
        maps = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(len(node), BITMAP_WORDS)
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side != -1)
        found = [np.zeros((0, 3), np.int64)]
        for i in left.tolist():
            j = right[right != i]
            j = j[(label[j] != label[i]) & (own[j] | own[i]) & (100 * np.minimum(n[j], n[i]) >= similar * np.maximum(n[j], n[i]))]
            if len(j):
                apart = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)
                total = n[j].astype(np.int64) + n[i]
                need = overlap_needed(total, np.int64(0), similar)
                fits = apart <= total - 2 * need - alone[j] - alone[i]
                j, need = j[fits], need[fits]
                found.append(np.stack([np.maximum(node[j], node[i]), np.minimum(node[j], node[i]), need - np.maximum(rest[j], rest[i])], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "least": pa.array(pairs[:, 2])})

    return run


def list_pairs(postings: DataFrame, labels: DataFrame, sets: DataFrame, similar: int, parts: int) -> DataFrame:
    """Pairs (a, b) left to probe in lists that hold several groups: those that share enough short lists.

    A list is searched by classes of size (neighbouring ones only can link) and, where a class is large, by
    pairs of its blocks of about BLOCK_DOCS sets, so that no list is one task's. Each list names a pair once, and every
    list that holds both sets of a pair holds several groups, so that the pair's number of lists is its T-occurrence count.
    """
    step = float(np.log(100 / similar))
    held = postings.drop("doc").join(labels, "node")
    mixed = held.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    held = held.join(mixed, "token").withColumn("g", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    # Class g is compared with itself and with g - 1; a pair of one class belongs where the class is its own.
    held = held.withColumn("at", F.explode(F.array(F.col("g"), F.col("g") + 1))).withColumn("own", F.col("at") == F.col("g"))
    sizes = held.groupBy("token", "at").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token", "at", F.ceil(F.col("c") / BLOCK_DOCS).cast("int").alias("blocks"))
    dealt = held.join(sizes, ["token", "at"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block i meets blocks j >= i: it is the left side there (-1), the right side (1), or both (0).
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", "at", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.signum((F.col("block") - F.col("other")).cast("double")).cast("int").alias("side"), "node", "n", "label", "long", "own")
    # Blocks are short in bytes and long in work: they are dealt to all tasks.
    dealt = dealt.join(sets.mapInArrow(_bitmaps, "node long, alone int, bitmap binary"), "node").repartition(parts, "token", "at", "i", "j")
    named = dealt.groupBy("token", "at", "i", "j").applyInArrow(_search(similar), "a long, b long, least long")
    return named.groupBy("a", "b").agg(F.count("*").alias("merged"), F.max("least").alias("least")).where("merged >= least").select("a", "b")


def groups(docs: DataFrame, size: int = 4, similar: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): linked documents have one component, its smallest doc_id."""
    n = width(docs)
    base = docs.select("doc_id", "text", document_chunk(n).alias(_CHUNK)).repartition(n, _CHUNK)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column("text")):
                part = batch.slice(a, b - a)
                sets, first = shingle_sets(pa.Table.from_batches([part]), size)
                s1, s2 = set_signatures(sets, first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column(_CHUNK), pa.array(np.diff(first)), pa.array(s1), pa.array(s2)], ["doc_id", "chunk", "n_shingles", "sig1", "sig2"])
        settle()

    signed = stored(base.mapInArrow(sign, "doc_id long, chunk int, n_shingles long, sig1 long, sig2 long"), "signatures").withColumn("doc", F.coalesce("doc_id", F.lit(_NULL)))
    alike = signed.where("n_shingles > 0").groupBy("sig1", "sig2").agg(F.min(F.struct("doc", "chunk")).alias("r"))
    nodes = stored(alike.select(F.monotonically_increasing_id().alias("node"), F.col("r.doc").alias("doc"), "sig1", "sig2", F.col("r.chunk").alias("chunk")), "nodes")
    sets = stored(candidate_sets(base, nodes, size, similar, n), "sets")
    postings = stored(sets.mapInArrow(_postings, "token long, node long, doc long, n int, long int"), "postings")
    heads = postings.groupBy("token").agg(F.min(F.struct("doc", "node", "n", "long")).alias("h"), F.count("*").alias("c")).where("c > 1").select("token", F.col("h.node").alias("b"), F.col("h.doc").alias("owner"), F.col("h.n").alias("m"), F.col("h.long").alias("long"))
    met = postings.select("token", "node").join(heads, "token").where("node <> b").groupBy("node").agg(F.collect_list(F.struct("token", "b", "owner", "m", "long")).alias("entries"))
    candidates = sets.join(met, "node").mapInArrow(_merge(similar), "a long, b long, need int, merged int, rest binary")
    first = stored(probed(candidates, sets), "links")
    labels = stored(sets.select("node").join(components(first).withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("rest"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    need = -F.floor(-(similar * (F.col("na") + F.col("nb"))) / (100 + similar))
    pairs = list_pairs(postings, labels, sets, similar, n).join(x, "a").join(y, "b").select("a", "b", need.cast("int").alias("need"), F.lit(0).alias("merged"), "rest")
    second = probed(pairs, sets)
    return labelled(signed, nodes, first.unionByName(second), _NULL)
