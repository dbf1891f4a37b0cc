"""Queries that go through files: raw logs, unified tables, splits, results (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators import metrics as m
from gavel.operators.explore import add_tags, tag_vocabulary
from gavel.plans.explore_queries import _VOCAB
from gavel.plans.feature_queries import _SPLIT, _splits
from gavel.plans.metric_queries import _SC, auc_sql
from gavel.registry import query, r6
from gavel.sources import logs as s
from gavel.tables import bids, scores


def _raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The bid table written as raw logs and read back; its rows are stored for the four logs."""
    df = bids(spark, sf_dir).withColumn("bidid", F.col("bidid").cast("string"))
    df = s.kept(df.select(*[c for c in df.columns if c in (*s.EVENT_COLUMNS, "win", "click", "conversion")]), "logged")
    out = {}
    for kind, flag in (("bid", None), ("imp", "win"), ("clk", "click"), ("conv", "conversion")):
        path = s.fresh(spark, f"raw-{kind}")
        columns = s.BID_COLUMNS if kind == "bid" else s.EVENT_COLUMNS
        s.write_logs(df if flag is None else df.where(F.col(flag) == 1), path, columns)
        out[kind] = s.read_logs(spark, path, kind)
    return out


@query("s1_s2_unify", "SELECT CAST(bidid AS VARCHAR) AS bidid, timestamp, bidprice, payprice, win, click, conversion, day FROM bids")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return s.unify(raw["bid"], raw["imp"], raw["clk"], raw["conv"]).select("bidid", "timestamp", "bidprice", "payprice", "win", "click", "conversion", "day")


@query("s3_s4_partitioned", "SELECT season, CAST(count(*) AS BIGINT) AS n, CAST(sum(payprice) AS BIGINT) AS spend FROM bids WHERE season = 3 GROUP BY 1")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = s.fresh(spark, "unified")
    s.write_unified(bids(spark, sf_dir).withColumn("day", F.floor(F.col("day") / 100).cast("long")), path)
    return s.scan_unified(spark, path, ["season", "payprice"]).where("season = 3").groupBy("season").agg(F.count("*").alias("n"), F.sum("payprice").alias("spend"))


@query("s5_validation", "SELECT 'click_without_win' AS problem, CAST(count(*) FILTER (click > win) AS BIGINT) AS n FROM bids UNION ALL SELECT 'conversion_without_click', CAST(count(*) FILTER (conversion > click) AS BIGINT) FROM bids UNION ALL SELECT 'price_on_loss', CAST(count(*) FILTER (win = 0 AND payprice <> 0) AS BIGINT) FROM bids UNION ALL SELECT 'paid_over_bid', CAST(count(*) FILTER (payprice > bidprice) AS BIGINT) FROM bids UNION ALL SELECT 'bad_label', CAST(count(*) FILTER (win NOT IN (0, 1) OR click NOT IN (0, 1)) AS BIGINT) FROM bids UNION ALL SELECT 'repeated_bidid', CAST(count(*) AS BIGINT) FROM (SELECT bidid FROM bids GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing_columns', CAST(0 AS BIGINT)")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.validate(bids(spark, sf_dir), s.UNIFIED)


@query("s7_sample", "SELECT CAST(least(count(*), 1000) AS BIGINT) AS n, CAST(least(count(*), 1000) AS BIGINT) AS distinct_bids, CAST(0 AS BIGINT) AS strangers FROM bids")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's size, its distinct bids, and those of its rows that the table lacks; which rows are drawn is the hash's."""
    df = bids(spark, sf_dir)
    got = s.sample(df, 1_000)
    strange = got.join(df.select("bidid"), "bidid", "left_anti").agg(F.count("*").alias("strangers"))
    return got.agg(F.count("*").alias("n"), F.count_distinct("bidid").alias("distinct_bids")).crossJoin(F.broadcast(strange))


@query("s8_manifest", f"{_SPLIT}, mf AS (SELECT split, count(*) AS n, count(*) FILTER (click > win) AS cw, avg(win) AS wr, sum(click) / CAST(nullif(sum(win), 0) AS DOUBLE) AS ctr FROM splits GROUP BY 1) SELECT split, CAST(n AS BIGINT) AS rows, CAST(0 AS BIGINT) AS bad_labels, CAST(cw AS BIGINT) AS click_over_win, round(wr, 6) AS win_rate, round(ctr, 6) AS ctr, CAST(0 AS INT) AS missing, CASE WHEN cw > 0 OR wr NOT BETWEEN 0.1 AND 0.9 OR ctr NOT BETWEEN 0 AND 0.2 THEN 'warn' ELSE 'ok' END AS verdict FROM mf")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _splits(spark, sf_dir)
    out = None
    for split in ("train", "val", "test"):
        row = s.manifest(df.where(F.col("split") == split), split, None, s.UNIFIED)
        out = row if out is None else out.unionByName(row)
    return r6(out.drop("schema_hash"))


@query("s9_s10_splits", f"{_SPLIT} SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(slotprice) AS BIGINT) AS floors FROM splits GROUP BY 1")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = s.fresh(spark, "splits")
    s.write_splits(_splits(spark, sf_dir).select("bidid", "slotprice", "domain", "split"), path)
    return s.read_splits(spark, path, ["split", "slotprice", "domain"]).groupBy("split").agg(F.count("*").alias("n"), F.sum("slotprice").alias("floors"))


@query("s8_file_digests")
def s8f(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = s.fresh(spark, "splits")
    s.write_splits(_splits(spark, sf_dir).select("bidid", "split"), path)
    return s.file_digests(spark, f"{path}/rows").select("length", "sha256")


@query("s11_results", f"{_SC}{auc_sql('model')} SELECT model, CASE model WHEN 'p_a' THEN 'nested' ELSE 'flat' END AS type, CASE model WHEN 'p_a' THEN 'won' END AS context, round(auc, 6) AS auc FROM au")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The AUC of two models by way of result files of two forms."""
    table = m.auc(scores(bids(spark, sf_dir)).where("win = 1"), "model").withColumn("auc", F.round("auc", 6))
    a, b = s.fresh(spark, "nested"), s.fresh(spark, "flat")
    s.write_results(table.where("model = 'p_a'").select("model", F.lit("won").alias("context"), F.struct("auc").alias("metrics")), a)
    s.write_results(table.where("model = 'p_b'").select(F.col("model").alias("model_name"), "auc"), b)
    return s.load_results(spark, a, b).select("model", "type", "context", "auc")


@query("s12_vocabulary_table", f"{_VOCAB} SELECT tag, CAST(n AS BIGINT) AS n, CAST(idx AS INT) AS idx FROM vo WHERE idx <= 20")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = s.fresh(spark, "vocabulary")
    tag_vocabulary(add_tags(bids(spark, sf_dir)), 20, 5).write.parquet(path)
    return spark.read.parquet(path)


@query("s13_first_rows", "SELECT round(least(greatest((l_quantity - 25.0) / 14.0, -5.0), 5.0), 6) + 0.0 AS l_quantity, round(least(greatest((l_discount - 0.05) / 0.03, -5.0), 5.0), 6) + 0.0 AS l_discount FROM (SELECT * FROM lineitem ORDER BY l_orderkey NULLS FIRST, l_linenumber NULLS FIRST, l_quantity NULLS FIRST, l_discount NULLS FIRST LIMIT 500)", bids=False)
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(s.first_rows(spark, f"{sf_dir}/lineitem.parquet", 500, {"l_quantity": (25.0, 14.0), "l_discount": (0.05, 0.03)}, ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]))
