"""Toxicity severity by cumulative-link (proportional-odds) ordinal regression over sparse word features.

Words are lower-cased, parted at white space and ASCII punctuation, and known
by their hashes. From a bounded sample of labelled rows (`SAMPLE_ROWS`, those
of the lowest hash of doc_id) Spark counts, for each word, the toxic and other
documents it is in; the `VOCABULARY` words of the largest chi-square become
features, valued by the log of one plus their occurrences. The labels only say
toxic or not, so grades are drawn from them: a toxic document's grade, 1 to
`GRADES`, is its quantile by occurrences of words that toxic documents have at
least `LIFT` times as often. One weight vector and ordered thresholds give
P(grade >= k) = sigmoid(w.x - t_k); the expected severity is their sum.

Defined results: null and empty texts have no words and get the severity of
the thresholds alone; labels without a toxic value are not learnt from; with no
toxic or no other labels every severity is 0; repeated rows are scored each;
other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gavel.llm.quality import labelled_sample
from gavel.llm.words import blocks, words

SAMPLE_ROWS = 20_000
VOCABULARY = 2_000
LEAST_DOCS = 4
GRADES = 3
LIFT = 20.0


@dataclass
class Ordinal:
    """vocabulary: sorted word hashes; weights: one for each; thresholds: ascending, one for each grade."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, raw: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., rows x grades."""
        return 1 / (1 + np.exp(-(raw[:, None] - self.thresholds[None, :])))


def counts(text: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, occurrences) of the vocabulary's words, sorted by row."""
    w = words(text, plain=True)
    if not len(vocabulary) or not len(w.hash):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
    hit = vocabulary[at] == w.hash
    key, n = np.unique(w.doc()[hit] * len(vocabulary) + at[hit], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), n


def fit_ordinal(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, steps: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the likelihood of grades 0..GRADES, by Adam on all rows.

    Thresholds are t_1 and positive steps after it (exponentials), so they stay in order.
    """
    n = len(grade)
    share = [np.clip((grade >= k).mean(), 1e-4, 1 - 1e-4) for k in range(1, GRADES + 1)]
    t0 = np.array([np.log((1 - s) / s) for s in share])
    theta = np.concatenate([np.zeros(n_features), [t0[0]], np.log(np.maximum(np.diff(t0), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, cut = theta[:n_features], np.cumsum(np.concatenate([theta[n_features : n_features + 1], np.exp(theta[n_features + 1 :])]))
        raw = np.bincount(row, w[feature] * value, n)
        tail = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-(raw[:, None] - cut))), np.zeros((n, 1))], 1)
        slope = tail * (1 - tail)
        i = np.arange(n)
        p = np.maximum(tail[i, grade] - tail[i, grade + 1], 1e-12)
        hi, lo = slope[i, grade] / p, slope[i, grade + 1] / p
        g_raw = -(hi - lo) / n
        g_cut = np.array([(np.where(grade == k, hi, 0) - np.where(grade + 1 == k, lo, 0)).sum() / n for k in range(1, GRADES + 1)])
        g_step = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(feature, g_raw[row] * value, n_features) + l2 * w, [g_step[0]], g_step[1:] * np.exp(theta[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:n_features], np.cumsum(np.concatenate([theta[n_features : n_features + 1], np.exp(theta[n_features + 1 :])]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Ordinal:
    """Choose the vocabulary and fit the model on a bounded sample of labelled rows."""
    sample = labelled_sample(docs, labels, "toxic", rows)

    def document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column("text")):
                part = batch.slice(a, b - a)
                w = words(part.column("text"), plain=True)
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                pair = np.unique(np.stack([w.hash.view(np.int64), w.doc()], 1), axis=0) if len(w.hash) else np.zeros((0, 2), np.int64)
                word, at = np.unique(pair[:, 0], return_inverse=True)
                bad = np.bincount(at, toxic[pair[:, 1]], len(word)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bad), pa.array(np.bincount(at, minlength=len(word)) - bad)], ["word", "bad", "good"])

    n_bad, n_good = (int(x or 0) for x in sample.agg(F.sum((F.col("toxic") > 0).cast("int")), F.sum((F.col("toxic") <= 0).cast("int"))).first())
    if not n_bad or not n_good:
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, np.inf))
    table = sample.withColumn("toxic", (F.col("toxic") > 0).cast("int")).mapInArrow(document_words, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") + F.col("good") >= LEAST_DOCS)
    a, b = F.col("bad") / n_bad, F.col("good") / n_good
    spread = (F.col("bad") + F.col("good")) / (n_bad + n_good)
    chosen = table.withColumn("chi", (a - b) * (a - b) / (spread * (1 - spread) + 1e-9)).orderBy(F.desc("chi"), "word").limit(VOCABULARY).toPandas()
    hashes = chosen["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    vocabulary, bad, good = hashes[order], chosen["bad"].to_numpy()[order] / n_bad, chosen["good"].to_numpy()[order] / n_good
    marks = bad > LIFT * (good + 0.5 / n_good)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in blocks(batch.column("text")):
                part = batch.slice(x, y - x)
                row, feature, n = counts(part.column("text"), vocabulary)
                first = np.searchsorted(row, np.arange(len(part) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(v)) for v in (feature, n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), *lists], ["doc_id", "toxic", "feature", "n"])

    got = sample.mapInArrow(rows_of, "doc_id long, toxic int, feature array<long>, n array<long>").toPandas().sort_values("doc_id")
    sizes = got["feature"].map(len).to_numpy()
    row = np.repeat(np.arange(len(got)), sizes)
    feature = np.concatenate([np.zeros(0, np.int64), *got["feature"]]).astype(np.int64)
    n = np.concatenate([np.zeros(0), *got["n"]]).astype(float)
    toxic = got["toxic"].to_numpy() > 0
    weight = np.bincount(row, n * marks[feature], len(got))
    edges = np.quantile(weight[toxic], np.linspace(0, 1, GRADES + 1)[1:-1])
    grade = np.where(toxic, 1 + np.searchsorted(edges, weight, "left"), 0)
    w, cut = fit_ordinal(row, feature, np.log1p(n), grade, len(vocabulary))
    return Ordinal(vocabulary, w, cut)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs with expected_severity (0 to GRADES) and at_least, the probabilities of each grade or a higher one; columns of these names are replaced."""
    docs = docs.drop("expected_severity", "at_least")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for a, b in blocks(batch.column(at)):
                part = batch.slice(a, b - a)
                row, feature, n = counts(part.column(at), held.value.vocabulary)
                raw = np.bincount(row, held.value.weights[feature] * np.log1p(n), len(part)) if len(row) else np.zeros(len(part))
                tail = held.value.at_least(raw)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tail.sum(1)), pa.array(list(tail), pa.list_(pa.float64()))], [*names, "expected_severity", "at_least"])

    return docs.mapInArrow(compute, StructType([*docs.schema.fields, StructField("expected_severity", DoubleType()), StructField("at_least", ArrayType(DoubleType()))]))
