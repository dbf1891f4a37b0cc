"""Connected components of an edge table, labelled by their smallest node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm.store import stored

#: Edges that one task joins up by itself; more are first drawn together by star rounds.
TASK_EDGES = 500_000


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of some edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((a, "a"), (b, "b")))
        if len(a) > TASK_EDGES:
            a, b = _union(a, b)
    node, label = _union(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b).

    Star rounds (each node's larger neighbours, then its smaller ones, move to
    its least neighbour) shrink the table until one task can hold it or it
    stops changing. An empty table gives no rows; edges from a node to itself
    and repeated edges do no harm.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().mapInArrow(_contract, "a long, b long"), "edges")
    while e.count() > TASK_EDGES:
        both = e.where("a <> b").unionByName(e.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = stored(small, "edges")
        if not nxt.exceptAll(e).take(1) and not e.where("a <> b").exceptAll(nxt).take(1):
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(nxt.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
        e = nxt
    return e.repartition(1).mapInArrow(_contract, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("label"))


def labelled(signed: DataFrame, nodes: DataFrame, links: DataFrame, null_doc: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents whose sets are nodes, from links (a, b) of nodes.

    signed: (doc_id, doc, n_shingles, sig1, sig2), a row for each row of the corpus; doc is doc_id, or null_doc without one.
    nodes: (node, doc, sig1, sig2), a row for each distinct set, doc being the smallest that has it.
    A doc whose rows have different sets ties those sets; null_doc alone is no component.
    """
    some = signed.where("n_shingles > 0")
    sig = F.struct("sig1", "sig2")
    several = some.groupBy("doc").agg(F.min(sig).alias("lo"), F.max(sig).alias("hi")).where("lo <> hi").select("doc")
    owners = some.join(several, "doc", "left_semi").select("doc", "sig1", "sig2").distinct().join(nodes.select("node", "sig1", "sig2"), ["sig1", "sig2"])
    own = owners.join(owners.groupBy("doc").agg(F.min("node").alias("b")), "doc").select(F.col("node").alias("a"), "b")
    grouped = stored(components(links.select("a", "b").unionByName(own)), "groups")
    least = grouped.join(nodes.select("node", "doc"), "node").groupBy("label").agg(F.min("doc").alias("least"))
    found = nodes.join(grouped.join(least, "label").select("node", "least"), "node", "left").select("sig1", "sig2", F.coalesce("least", "doc").alias("component"))
    label = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc"))
    return signed.join(found, ["sig1", "sig2"], "left").select("doc_id", "n_shingles", F.when(label == null_doc, None).otherwise(label).alias("component_id"))
