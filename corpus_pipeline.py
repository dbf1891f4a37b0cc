"""A training-data pipeline of five operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. The first four return the columns of `documents`; the last
returns the packed pieces. run() writes each stage's rows into the shared
folder and reads them back, so that lineage is short and a lost executor costs
one stage's tasks. Rejected documents go; of each near-duplicate group the
smallest doc_id stays; repeated passages are cut out of the texts (n_chars
follows); contaminated documents go; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.llm.store import stored

#: Documents of a lower probability of good quality are rejected.
LEAST_QUALITY = 0.3
#: Words of a shingle, and percent of two sets' union, for near duplicates.
SHINGLE, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    from gavel.llm.quality import fit, score

    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of the smallest doc_id."""
    from gavel.llm.jaccard import groups

    found = groups(docs.select("doc_id", "text"), SHINGLE, SIMILAR)
    gone = found.where("doc_id > component_id or (doc_id is null and component_id is not null)").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand earlier."""
    from gavel.llm.recompression import dedup

    cut = dedup(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    from gavel.llm.decontam import clean

    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    import public_tokenizers

    from gavel.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 0)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("packing", packing)]
#: The classifier is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
