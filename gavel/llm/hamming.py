"""MinHash near duplicates by a multi-index Hamming join, and the groups that confirmed links make.

A document's set is its distinct word shingles. Its signature is `values`
min-hashes of `BITS` bits each; the distance of two signatures is how many of
these differ. Equal sets are one node. Then:

1. Pigeonhole. A signature is split into `chunks`. If two are at most
   chunks * (errors + 1) - 1 apart, some chunk differs in at most `errors`
   values. All ways of leaving `errors` values of a chunk out are enumerated,
   each giving one key of the values that stay; so any two signatures within
   that distance share a key, without exception.
2. Nodes are dealt into blocks, which ask a range exchange (see `exchange`)
   for the head of each of their keys: the smallest node that has it. Nodes
   whose keys nobody else has end here. A key that a third of all nodes have
   is one entry of each block.
3. Nodes are compared with the heads of their keys: pairs beyond the distance,
   or that sizes or parity bitmaps (a lower bound of the sets' symmetric
   difference) rule out, go; the others are confirmed on their full sets,
   which are computed anew from the texts of these nodes.
4. Links make groups. Keys whose nodes are still in several groups (a second
   exchange finds them) are searched whole, in pairs of blocks: all pairs of
   different groups that are left by the same rules, each at the least key it
   shares only, are confirmed likewise.

With 64 values, 12 chunks and one error every pair of at most 23 differing
values is found. Linked sets (similarity 0.85) differ in 9.6 on average and
in more than 23 with a probability of about 1 in 100,000, which is what can be
missed; nothing else is: no cap, sample or bound that isn't proven.

Defined results: null and empty texts and texts without words have an empty
set and link with nothing; fewer words than a shingle has are one shingle;
rows of one doc_id that have words are one document, linked by any of its
texts; null doc_ids are one document that is larger than all others, and its
component is null if it has no smaller member (then kept is true); an empty
table gives no rows; only (doc_id, text) are read, so that other columns'
names don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.components import components, labelled
from gavel.llm.exchange import BLOCK_SQL, answered, blocks_of, joined_answers
from gavel.llm.jaccard import overlap_needed, set_signatures, shingle_sets
from gavel.llm.store import settle, settled, settled_pair, stored, width
from gavel.llm.words import blocks, mix

VALUES, CHUNKS, ERRORS = 64, 12, 1
BITS = 16
#: Bits of a set's parity bitmap.
PARITY = 1024
_NULL = (1 << 63) - 1
_KEY = 48  # bits of a key; a clash only makes a pair to be ruled out
#: Nodes of a side of one pair of blocks.
BLOCK_NODES = 1_000
#: Pairs compared at once inside a task.
_PAIRS = 200_000
#: Into how many groups the pairs of one node are dealt when its set is laid beside them.
SALTS = 32
_NODE_BYTES = 2 << 20  # of stored nodes in one block of the exchange


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20260301)
    x = rng.integers(1, 1 << 63, (2, 1024), dtype=np.uint64)[:, :n]
    return x[0], x[1] | np.uint64(1)


def min_hashes(sets: np.ndarray, first: np.ndarray, values: int = VALUES) -> np.ndarray:
    """(documents, values) min-hashes of BITS bits of each set; those of an empty set are 0."""
    some = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, values), np.uint16)
    if len(some):
        at = first[:-1][some]
        for k, (c, odd) in enumerate(zip(*_constants(values), strict=True)):
            out[some, k] = mix(np.minimum.reduceat((sets ^ c) * odd, at)).astype(np.uint16)
    return out


def parity_bitmaps(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(documents, PARITY / 8) bytes: whether an odd number of a set's members has each remainder."""
    out = [np.zeros((0, PARITY // 8), np.uint8)]
    for a in range(0, len(first) - 1, 1000):
        ends = first[a : a + 1001]
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        at = doc * PARITY + (sets[ends[0] : ends[-1]] % np.uint64(PARITY)).astype(np.int64)
        odd = np.bincount(at, minlength=(len(ends) - 1) * PARITY) & 1
        out.append(np.packbits(odd.astype(bool)).reshape(-1, PARITY // 8))
    return np.concatenate(out)


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, similar: int, most: int) -> np.ndarray:
    """Which pairs of signatures are near enough, of sizes that can reach the similarity, and not ruled out by parity. A row is min-hashes, then parity bits."""
    fits = 100 * np.minimum(n, m) >= similar * np.maximum(n, m)
    values = x.shape[1] - PARITY // 16
    fits &= np.count_nonzero(x[:, :values] != y[:, :values], axis=1) <= most
    apart = np.bitwise_count(x[:, values:] ^ y[:, values:]).sum(1, dtype=np.int64)
    return fits & (apart <= n + m - 2 * overlap_needed(n, m, similar))


def distance_found(values: int = VALUES, chunks: int = CHUNKS, errors: int = ERRORS) -> int:
    """The distance up to which every pair of signatures shares a key."""
    if not 0 <= errors < values // chunks:
        raise ValueError("a chunk needs more values than the errors allowed")
    return chunks * (errors + 1) - 1


def chunk_keys(values: np.ndarray, chunks: int = CHUNKS, errors: int = ERRORS) -> np.ndarray:
    """(signatures, keys): for each chunk and each choice of `errors` of its values, a key of the others."""
    n, width_ = values.shape
    place = np.arange(width_, dtype=np.uint64) << np.uint64(BITS)
    held = mix(values.astype(np.uint64) + place + np.uint64(1))
    ends = np.linspace(0, width_, chunks + 1).astype(int)
    keys = []
    for lo, hi in itertools.pairwise(ends):
        total = held[:, lo:hi].sum(1, dtype=np.uint64)
        for left in itertools.combinations(range(lo, hi), errors):
            rest = total - held[:, list(left)].sum(1, dtype=np.uint64)
            keys.append(mix(rest + np.uint64(len(keys) + 1)) >> np.uint64(64 - _KEY))
    return np.stack(keys, 1) if n else np.zeros((0, len(keys)), np.uint64)


def _matrix(column: pa.ChunkedArray | pa.Array, values: int) -> np.ndarray:
    """Rows of min-hashes with their parity bits."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, values + PARITY // 16)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((),) * len(schema), schema, strict=True)], schema=schema)


def _extremes(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least of low and the greatest of high of each, and each row's place among the keys."""
    key, at = np.unique(keys, return_inverse=True)
    lo, hi = np.full(len(key), _NULL, np.int64), np.full(len(key), -1, np.int64)
    np.minimum.at(lo, at, low)
    np.maximum.at(hi, at, high)
    return key, lo, hi, at


_SHARED = pa.schema([("node", pa.int64()), ("block", pa.int32()), ("heads", pa.list_(pa.int64())), ("keys", pa.binary())])


def shared_keys(nodes: DataFrame, n: int, chunks: int, errors: int, values: int) -> DataFrame:
    """(node, block, heads, keys) of the nodes that share keys with others: these keys, and their smallest nodes other than itself.

    nodes: (node, block, values), dealt into n blocks.
    """

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node = table.column("node").to_numpy()
        keys = chunk_keys(_matrix(table.column("values"), values)[:, :values], chunks, errors)
        return np.repeat(node, keys.shape[1]), keys.ravel()

    def emit(table: pa.Table) -> pa.Table:
        node, keys = keys_of(table)
        key, lo, hi, _ = _extremes(keys, node, node)
        return blocks_of(key, [lo, hi], table.column("block")[0].as_py(), _KEY)

    def head(names: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        _, lo, hi, at = _extremes(names, *columns)
        return np.where(lo < hi, lo, -1)[at]

    def choose(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return _SHARED.empty_table()
        node, keys = keys_of(table)
        heads = joined_answers(replies, "<i8")[np.unique(keys, return_inverse=True)[1]]
        block, rows = table.column("block")[0].as_py(), []
        each = len(keys) // len(table)
        held = heads.reshape(-1, each) >= 0
        for i in np.flatnonzero(held.any(1)).tolist():
            own, mine = int(node[i * each]), heads[i * each : (i + 1) * each][held[i]]
            rows.append((own, block, [h for h in np.unique(mine).tolist() if h != own], keys[i * each : (i + 1) * each][held[i]].astype("<u8").tobytes()))
        return _table(rows, _SHARED)

    replies = answered(nodes.groupBy("block").applyInArrow(settled(emit), BLOCK_SQL), n, _KEY, ["<i8", "<i8"], head, reply="<i8")
    return nodes.groupBy("block").cogroup(replies.groupBy("chunk")).applyInArrow(settled_pair(choose), "node long, block int, heads array<long>, keys binary")


def beside(pairs: DataFrame, side: str, table: DataFrame) -> DataFrame:
    """pairs (a, b, ..) with the columns of table, which has one row for each node, of the node in `side`.

    A node's pairs are dealt into SALTS groups by the other side, and its row is copied to those that it has.
    """
    other = "b" if side == "a" else "a"
    cut = pairs.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    copies = cut.select(side, "_salt").distinct().join(table.withColumnRenamed("node", side), side)
    return cut.join(copies, [side, "_salt"]).drop("_salt")


def near(pairs: DataFrame, nodes: DataFrame, similar: int, most: int, values: int) -> DataFrame:
    """The possible pairs of (a, b), with `need`."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(c), values) for c in ("x", "y"))
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "m"))
            fits = possible(x, y, n, m, similar, most)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(overlap_needed(n, m, similar))], ["a", "b", "need"]).filter(pa.array(fits))

    held = beside(pairs, "a", nodes.select("node", F.col("values").alias("x"), "n"))
    held = beside(held, "b", nodes.select("node", F.col("values").alias("y"), F.col("n").alias("m")))
    return held.select("a", "b", "x", "y", "n", "m").mapInArrow(keep, "a long, b long, need long")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, tokens): the shingles, ascending, of wanted (node, doc, text_hash)."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column("text")):
                part = batch.slice(a, b - a)
                sets, first = shingle_sets(pa.Table.from_batches([part]), size)
                raw, ends = memoryview(sets.astype("<u8")), first.tolist()
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([raw[x:y].tobytes() for x, y in itertools.pairwise(ends)], pa.binary())], ["node", "tokens"])
        settle()

    # Rows of one doc_id and text are one set.
    rows = docs.join(wanted, ["doc", "text_hash"]).dropDuplicates(["doc", "text_hash"])
    return rows.select("node", "text").mapInArrow(sets_of, "node long, tokens binary")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets share as many members as they need."""
    for batch in batches:
        links = np.zeros(len(batch), bool)
        for i, (x, y, need) in enumerate(zip(batch.column("x"), batch.column("y"), batch.column("need").to_pylist(), strict=True)):
            a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            links[i] = len(np.intersect1d(a, b, assume_unique=True)) >= need
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(links))


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, name: str) -> DataFrame:
    """The stored pairs (a, b, need) whose full sets are similar enough, stored."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(full_sets(docs, nodes.select("node", "doc", "text_hash").join(wanted, "node", "left_semi"), size), f"{name}-sets")
    held = beside(pairs, "a", sets.withColumnRenamed("tokens", "x"))
    held = beside(held, "b", sets.withColumnRenamed("tokens", "y"))
    return stored(held.select("a", "b", "need", "x", "y").mapInArrow(_confirm, "a long, b long"), f"{name}-links")


def mixed_pairs(shared: DataFrame, nodes: DataFrame, labels: DataFrame, n: int, similar: int, chunks: int, errors: int, values: int) -> DataFrame:
    """Possible pairs (a, b, need) of different groups, from the keys whose nodes are in several groups."""
    most = distance_found(values, chunks, errors)

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = [np.frombuffer(k, "<u8") for k in table.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        return np.concatenate(keys), np.repeat(table.column("node").to_numpy(), sizes), np.repeat(table.column("label").to_numpy(), sizes)

    def emit(table: pa.Table) -> pa.Table:
        keys, _, label = keys_of(table)
        key, lo, hi, _ = _extremes(keys, label, label)
        return blocks_of(key, [lo, hi], table.column("block")[0].as_py(), _KEY)

    def several(names: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        _, lo, hi, at = _extremes(names, *columns)
        return (lo < hi)[at]

    def choose(table: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("label", pa.int64())])
        if not len(table):
            return schema.empty_table()
        keys, node, label = keys_of(table)
        mixed = joined_answers(replies)[np.unique(keys, return_inverse=True)[1]] > 0
        return pa.Table.from_arrays([pa.array(keys[mixed].astype(np.int64)), pa.array(node[mixed]), pa.array(label[mixed])], schema=schema)

    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        """Possible pairs of whole runs (key, i, j); a run of one block pairs its rows, others their left with their right rows."""
        key, i, j, side, node, label, size = (table.column(c).to_numpy() for c in ("key", "i", "j", "side", "node", "label", "n"))
        x = _matrix(table.column("values"), values)
        new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        end = np.append(start[1:], len(key))[run]
        middle = start[run] + np.bincount(run, side < 0, len(start)).astype(np.int64)[run]
        low = np.where(side == 0, np.arange(len(key)) + 1, np.where(side < 0, middle, end))
        total = np.append(0, np.cumsum(end - low))
        found, at = [np.zeros((0, 3), np.int64)], 0
        while at < len(key):
            stop = max(at + 1, int(np.searchsorted(total, total[at] + _PAIRS, "right")) - 1)
            each = (end - low)[at:stop]
            p = np.repeat(np.arange(at, stop), each)
            q = np.arange(len(p)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low[at:stop], each)
            for rule in (lambda p, q: label[p] != label[q], lambda p, q: possible(x[p], x[q], size[p], size[q], similar, most)):
                keep = rule(p, q)
                p, q = p[keep], q[keep]
            if len(p):
                rows, back = np.unique(np.concatenate([p, q]), return_inverse=True)
                keys = chunk_keys(x[rows][:, :values], chunks, errors)
                u, v = keys[back[: len(p)]], keys[back[len(p) :]]
                here = np.where(u == v, u, np.uint64(1 << 63)).min(1) == key[p].astype(np.uint64)
                p, q = p[here], q[here]
                found.append(np.stack([np.maximum(node[p], node[q]), np.minimum(node[p], node[q]), overlap_needed(size[p], size[q], similar)], 1))
            at = stop
        pairs = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(3)], ["a", "b", "need"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs, which may go on in the next batch, some at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 5 * BLOCK_NODES:
                table = pa.Table.from_batches(held)
                cols = [table.column(c).to_numpy() for c in ("key", "i", "j")]
                other = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield pairs_of(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield pairs_of(pa.Table.from_batches(held))
        settle()

    told = shared.select("node", "block", "keys").join(labels, "node")
    replies = answered(told.groupBy("block").applyInArrow(settled(emit), BLOCK_SQL), n, _KEY, ["<i8", "<i8"], several)
    held = stored(told.groupBy("block").cogroup(replies.groupBy("chunk")).applyInArrow(settled_pair(choose), "key long, node long, label long"), "mixed")
    sizes = held.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("blocks"))
    dealt = held.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block i meets blocks j >= i: it is the left side there (-1), the right side (1), or both (0).
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.signum((F.col("own") - F.col("other")).cast("double")).cast("int").alias("side"), "node", "label")
    dealt = dealt.join(nodes.select("node", "values", "n"), "node").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return dealt.mapInArrow(search, "a long, b long, need long")


def groups(docs: DataFrame, size: int = 5, similar: int = 85, values: int = VALUES, chunks: int = CHUNKS, errors: int = ERRORS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): linked documents have one component, its smallest doc_id, which is kept."""
    most = distance_found(values, chunks, errors)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), "text", F.xxhash64("text").alias("text_hash"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column("text")):
                part = batch.slice(a, b - a)
                sets, first = shingle_sets(pa.Table.from_batches([part]), size)
                s1, s2 = set_signatures(sets, first)
                raw = [x.tobytes() for x in np.concatenate([min_hashes(sets, first, values).astype("<u2"), parity_bitmaps(sets, first).view("<u2")], 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "doc", "text_hash")), pa.array(np.diff(first)), pa.array(s1), pa.array(s2), pa.array(raw, pa.binary())], ["doc_id", "doc", "text_hash", "n_shingles", "sig1", "sig2", "values"])
        settle()

    signed = stored(base.mapInArrow(sign, "doc_id long, doc long, text_hash long, n_shingles long, sig1 long, sig2 long, values binary"), "signatures")
    alike = signed.where("n_shingles > 0").groupBy("sig1", "sig2").agg(F.min(F.struct("doc", "text_hash")).alias("r"), F.min("n_shingles").alias("n"), F.min("values").alias("values"))
    nodes = stored(alike.select(F.monotonically_increasing_id().alias("node"), "r.doc", "r.text_hash", "n", "sig1", "sig2", "values"), "nodes")
    n = width(nodes, _NODE_BYTES)
    dealt = nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int").alias("block"), "values")
    shared = stored(shared_keys(dealt, n, chunks, errors, values), "shared")
    first_pairs = stored(near(shared.select(F.col("node").alias("a"), F.explode("heads").alias("b")), nodes, similar, most, values), "first-near")
    texts = base.select("doc", "text_hash", "text")
    first = confirmed(first_pairs, texts, nodes, size, "first")
    met = components(first).withColumnRenamed("node", "_node")
    labels = shared.select("node").join(met, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("label", "node").alias("label"))
    second_pairs = mixed_pairs(shared, nodes, stored(labels, "labels"), n, similar, chunks, errors, values).join(first_pairs, ["a", "b"], "left_anti")
    second = confirmed(stored(second_pairs, "second-near"), texts, nodes, size, "second")
    found = labelled(signed, nodes, first.unionByName(second), _NULL)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
