import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gavel.llm.packing import pack

from .conftest import SF, shape
from .test_duplicates import brute_dedup, brute_groups


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave on the small tables, where some 70 labels are all there is to learn from."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen.append((name, docs, out))
        docs = out
    return seen


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(stages):
    assert [n for n, *_ in stages] == ["quality", "near_duplicates", "substrings", "decontamination", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_quality_keeps_good_documents(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = before.join(labels.where("quality = 1"), "doc_id", "left_semi")
    lost = good.join(after, "doc_id", "left_anti").count()
    bad_left = after.join(labels.where("quality = 0"), "doc_id", "left_semi").count()
    assert lost <= 0.05 * good.count() and bad_left <= 0.5 * labels.where("quality = 0").count()


def test_near_duplicates(stages):
    _, before, after = stages[1]
    want = {i for i, _, c in brute_groups(pairs(before), 5, 80) if i == c}
    assert {i for i, _ in pairs(after)} == want


def test_substrings(stages):
    _, before, after = stages[2]
    want = {r[0]: r[2] for r in brute_dedup(pairs(before), 20)}
    got = dict(pairs(after))
    for i, t in pairs(before):
        assert got[i] == t if not want[i] else len(got[i].split()) == len(t.split()) - want[i]
    assert after.where(F.length("text") != F.col("n_chars")).join(before, "doc_id").count() == before.where(F.length("text") != F.col("n_chars")).count()


def test_decontamination(spark, stages):
    _, before, after = stages[3]
    import re

    bench = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench = [" ".join(b) for b in bench]
    whole = {i for i, t in pairs(before) if any(b in " ".join(re.findall(r"[^\W_]+", t.lower())) for b in bench)}
    kept = {i for i, _ in pairs(after)}
    assert not whole & kept and before.count() - after.count() <= len(whole) + 5


def test_packing(spark, stages):
    _, before, after = stages[4]
    want = pack(before, public_tokenizers.path("word_bpe_49k.json"), 0)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, after.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_stages_of_odd_rows_and_of_none(spark, odd_rows):
    """Every stage takes nulls, empties, repeated rows and columns of clashing names, and an empty table."""
    for rows in (odd_rows, []):
        docs = shape(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns, name
            assert got.count() <= len(rows)
        packed = corpus_pipeline.packing(spark, docs, SF)
        assert packed.select("doc_id").count() == 0 if not rows else packed.count() >= len(rows)
