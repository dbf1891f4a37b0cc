"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a document (shares of kinds of bytes, word lengths, repeats of
words, lines and trigrams) are computed for whole Arrow batches. The trees are
fitted on a bounded sample of labelled rows (`SAMPLE_ROWS`, those of the lowest
hash of doc_id): features are cut into at most `BINS` quantile bins, each level
of a tree is grown from one histogram of gradients, and trees are complete, so
that a model is three arrays (feature, threshold, leaf value) which numpy walks
for all documents and all trees at once.

Defined results: null and empty texts have the statistics of an empty text and
are scored like any other; a null doc_id counts as the text ''; labels without
a quality are not learnt from; with no labels at all every score is 0.5;
repeated rows are scored each; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.store import stored
from gavel.llm.words import blocks, rolled, words

SAMPLE_ROWS = 20_000
BINS, TREES, DEPTH, RATE, L2 = 64, 80, 4, 0.15, 5.0
FEATURES = ["log_bytes", "log_words", "mean_word", "longest_word", "ascii_letters", "capitals", "digits", "wide", "symbols", "bars", "stops", "lines", "distinct_words", "repeated_next", "distinct_trigrams", "longest_run", "capital_words", "repeated_lines"]

_KIND = np.zeros((7, 256), np.float64)
_KIND[0, [*range(65, 91), *range(97, 123)]] = 1
_KIND[1, 65:91] = 1
_KIND[2, 48:58] = 1
_KIND[3, 128:] = 1
_KIND[4, [ord(c) for c in "*$%&#!@^~<>=+{}[]\\_"]] = 1
_KIND[5, ord("|")] = 1
_KIND[6, [ord(c) for c in ".,;:?"]] = 1


def _per(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values in each document's range."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many different values of h each document has."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n).astype(float)


def statistics(text: pa.Array) -> np.ndarray:
    """FEATURES of each row."""
    w = words(text)
    n, count = len(text), w.count().astype(float)
    doc = w.doc()
    size = np.diff(np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64))])).astype(float)
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    some, any_word = np.maximum(size, 1), np.maximum(count, 1)
    length = (w.end - w.begin).astype(float)
    kinds = np.bincount(np.repeat(np.arange(n), size.astype(np.int64)) * 256 + w.data, minlength=256 * n).reshape(n, 256) if n else np.zeros((0, 256))
    share = kinds @ _KIND.T / some[:, None]
    newlines = kinds[:, 10] + 1
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    tri = rolled(w.hash, 3)
    inside = doc[: len(tri)] == doc[2:] if len(tri) else np.zeros(0, bool)
    tri_doc = doc[: len(tri)][inside]
    run = np.zeros(n)
    if len(same):
        start = np.flatnonzero(same == 0)
        np.maximum.at(run, doc[start], np.diff(np.append(start, len(same))).astype(float))
    capital = (w.data[w.begin] >= 65) & (w.data[w.begin] <= 90) & (w.data[np.minimum(w.begin + 1, len(w.data) - 1)] <= 90) & (length > 1) if len(w.begin) else np.zeros(0)
    breaks = np.flatnonzero(w.data == 10)
    edge = np.unique(np.concatenate([off[:-1], breaks + 1])) if len(w.data) else np.zeros(0, np.int64)
    edge = edge[edge < len(w.data)]
    line_doc = np.searchsorted(off, edge, "right") - 1
    word_at = np.searchsorted(w.begin, edge)
    # A line's key is the sum of its words' hashes, whatever their order.
    plain = np.concatenate([[np.uint64(0)], np.cumsum(w.hash, dtype=np.uint64)])
    stop = np.append(word_at[1:], len(w.hash)) if len(word_at) else word_at
    key = plain[stop] - plain[word_at] if len(word_at) else np.zeros(0, np.uint64)
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    cols = [np.log1p(size), np.log1p(count), _per(length, w.first) / any_word, longest, *share.T, newlines / some, _distinct(w.hash, doc, n) / any_word, _per(same, w.first) / any_word, _distinct(tri[inside], tri_doc, n) / np.maximum(np.bincount(tri_doc, minlength=n), 1), np.log1p(run), _per(capital, w.first) / any_word, 1 - _distinct(key, line_doc, n) / lines]
    return np.stack(cols, 1)


@dataclass
class Trees:
    """feature and threshold: trees x inner nodes, in heap order; leaf: trees x leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, by walking all trees level by level."""
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        for _ in range(DEPTH if len(tree) else 0):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        raw = self.base + (self.leaf[tree, at - inner].sum(1) if len(tree) else np.zeros(len(x)))
        return 1 / (1 + np.exp(-raw))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost TREES trees of DEPTH levels on the logistic loss."""
    inner = (1 << DEPTH) - 1
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    raw, n_feat = np.full(len(y), base), x.shape[1]
    feature, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, nodes = (1 << depth) - 1, 1 << depth
            local = at - first
            slot = (local[:, None] * n_feat + np.arange(n_feat)) * BINS + binned
            gs = np.bincount(slot.ravel(), np.repeat(g, n_feat), nodes * n_feat * BINS).reshape(nodes, n_feat, BINS).cumsum(2)
            hs = np.bincount(slot.ravel(), np.repeat(h, n_feat), nodes * n_feat * BINS).reshape(nodes, n_feat, BINS).cumsum(2)
            gl, hl, ga, ha = gs[:, :, :-1], hs[:, :, :-1], gs[:, :, -1:], hs[:, :, -1:]
            gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
            gain[(hl < 1) | (ha - hl < 1)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), BINS - 1)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > threshold[t, at])
        gsum, hsum = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaf[t] = RATE * gsum / (hsum + L2)
        raw += leaf[t, at - inner]
    return Trees(base, feature, threshold, leaf)


def held_out(doc_id: Column) -> Column:
    """Rows that are not learnt from: crc32 of the id's text is a multiple of 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled ids, those of the lowest hash, stored; ids that are held out are left out; of several texts of one id the least counts."""
    chosen = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias(label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max(label).alias(label))
    return stored(found, "sample")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column("text")):
                part = batch.slice(a, b - a)
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    got = labelled_sample(docs, labels, "quality", rows).mapInArrow(compute, "doc_id long, quality int, x array<double>").toPandas()
    got = got.sort_values("doc_id")
    return fit_trees(np.stack(got["x"]) if len(got) else np.zeros((0, len(FEATURES))), got["quality"].to_numpy(float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with `score`, the probability of good quality; a column of that name is replaced."""
    docs = docs.drop("score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index("text")
            for a, b in blocks(batch.column(at)):
                part = batch.slice(a, b - a)
                x = statistics(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held.value.score(x))], [*names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(compute, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
