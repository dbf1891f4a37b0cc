"""One query for each operator of this subpackage, over its whole table, and the SQL twins where there are any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.wavelet import token_output

    return token_output(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.recompression import dedup

    return dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False, digests=True)


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.audio import features, store_text

    return features(store_text(_table(spark, sf_dir, "documents")), keep_tensors=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.warc import archive

    return archive(_table(spark, sf_dir, "pages"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.jaccard import groups

    return groups(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.quality import fit, held_out, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    grade = sum(((F.col("at_least")[k] >= 0.5).cast("int") for k in range(3)), F.lit(0))
    return scored.select("doc_id", "expected_severity", grade.alias("grade"), (F.col("at_least")[0] >= 0.5).cast("int").alias("toxic"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.merkle import manifest, tampered_rows, verified

    return verified(manifest(_table(spark, sf_dir, "documents"), tamper=tampered_rows))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.alignment import align

    return align(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.llm.hamming import groups

    return groups(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from gavel.llm.licenses import scan_sql
    from gavel.llm.merkle import manifest_sql

    return {"op3_licenses": scan_sql(), "op11_merkle": manifest_sql()}
