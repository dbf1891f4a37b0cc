import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gavel.llm.merkle import FIELDS, manifest, manifest_sql, tampered_rows, verified

from .conftest import SF, shape

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    out = []
    for c in FIELDS:
        v = row[c]
        if v is not None and c == "text" and lower:
            v = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in v)
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return sha(*out)


def build(nodes, arity):
    """The root, and for each node the siblings (before, after) level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k - k % arity : k - k % arity + arity]
            paths[i].append(("".join(run[: k % arity]), "".join(run[k % arity + 1 :])))
        nodes = [sha(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
        at = [k // arity for k in at]
    return nodes[0], paths


def brute(rows, arity=8):
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], []
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=order)
        trees.append((own, *build([leaf_of(r) for r in own], arity)))
    root, upper = build([t[1] for t in trees], arity)
    for (own, subroot, paths), above in zip(trees, upper, strict=True):
        for r, path in zip(own, paths, strict=True):
            i, h = r["doc_id"], None
            h = leaf_of(r, lower=i is not None and zlib.crc32(str(i).encode()) % 3 == 0)
            for before, after in path + above:
                h = sha(before, h, after)
            out.append((i, leaf_of(r), subroot, root, sha(*(a + b for a, b in path + above)), h, h == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


@pytest.mark.parametrize(("arity", "seed"), [(8, 0), (2, 1), (3, 2)])
def test_against_trees_by_hand(spark, arity, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    sizes = {"en": 75, "de": 8, "fr": 1, None: 9, "": 2, "é": 64, "zz": 65} | {f"l{k}": 1 for k in range(6)}
    ids = iter(rng.permutation(1000).tolist())
    rows = [{"doc_id": next(ids), "source": "s" if rng.random() < 0.9 else None, "lang": lang, "n_chars": int(rng.integers(0, 99)), "text": f"Text {rng.integers(0, 50)} ÄÖ Aé"} for lang, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    got = rows_of(verified(manifest(df, arity, tamper=tampered_rows)))
    assert got == brute(rows, arity)
    assert 0 < sum(not r[6] for r in got) < len(got)
    assert all(r[6] for r in rows_of(verified(manifest(df, arity))))


def test_odd_rows(spark, odd_rows):
    df = shape(spark, odd_rows).withColumn("idx", F.lit("x")).withColumn("path", F.lit("x")).withColumn("tree", F.lit(None).cast("string"))
    df = df.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") == 4, F.lit(None)).otherwise(F.col("n_chars")))
    df = df.unionByName(df.where("doc_id = 2")).unionByName(df.where("doc_id is null"))
    rows = [r.asDict() for r in df.select(*FIELDS).collect()]
    assert rows_of(verified(manifest(df, tamper=tampered_rows))) == brute(rows)
    assert verified(manifest(df.where("1 = 0"), tamper=tampered_rows)).count() == 0
    one = df.where("doc_id = 6")
    assert rows_of(verified(manifest(one, tamper=tampered_rows))) == brute([r.asDict() for r in one.select(*FIELDS).collect()])


def test_a_changed_digest_is_noticed(spark):
    """Each leaf folds to the root with its own siblings only."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    proved = manifest(docs).withColumn("tampered_leaf", F.when(F.col("doc_id") == 5, F.sha2(F.lit("other"), 256)))
    assert [r.doc_id for r in verified(proved).where("not verified").collect()] == [5]


def test_query_and_twin(spark, duck):
    from gavel.llm.queries import queries

    want = duck.execute(manifest_sql()).fetchall()
    got = queries()["op11_merkle"](spark, SF)
    assert got.columns == COLUMNS and rows_of(got) == sorted(want, key=str)
    assert rows_of(got) == brute([r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
