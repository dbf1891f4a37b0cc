"""Queries of features (F), splits (P) and statistics (J), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions.columns import cross_entropy, effect_label
from gavel.operators import features as f
from gavel.plans.twins import fold_sql, hash_sql, signed, uniform_sql
from gavel.registry import query, r6
from gavel.sources.logs import kept
from gavel.tables import bids, scores

_GROUP = """CASE WHEN (slotwidth = 728 AND slotheight = 90) OR (slotwidth = 970 AND slotheight IN (90, 250)) THEN 'leaderboard'
  WHEN (slotwidth = 300 AND slotheight = 250) OR (slotwidth = 336 AND slotheight = 280) THEN 'medium_rectangle'
  WHEN slotheight = 600 AND slotwidth IN (120, 160, 300) THEN 'skyscraper'
  WHEN (slotwidth = 250 AND slotheight = 250) OR (slotwidth = 200 AND slotheight = 200) THEN 'square'
  WHEN (slotwidth = 320 AND slotheight IN (50, 100)) OR (slotwidth = 300 AND slotheight = 50) THEN 'mobile'
  WHEN slotwidth = 468 AND slotheight = 60 THEN 'banner' ELSE 'other' END"""
_KIND = "CASE WHEN advertiser IN (2821, 3358, 2259) THEN 'retargeting' WHEN advertiser IN (1458, 3386, 3427, 2261, 2997) THEN 'branding' WHEN advertiser = 3476 THEN 'mixed' ELSE 'unknown' END"
_WD = "CAST(isodow(try_strptime(substr(timestamp, 1, 8), '%Y%m%d')) - 1 AS INT)"
_KEY = ["advertiser", "season", "day", "hour", "minute", "bidid"]
_SPLIT = """, fr AS (SELECT *, (row_number() OVER (PARTITION BY advertiser ORDER BY season, day, hour, minute, bidid) - 1) / CAST(count(*) OVER (PARTITION BY advertiser) AS DOUBLE) AS fraction FROM bids),
splits AS (SELECT *, CASE WHEN fraction < 0.7 THEN 'train' WHEN fraction < 0.85 THEN 'val' ELSE 'test' END AS split FROM fr)
"""


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.split_by_group(bids(spark, sf_dir), "advertiser", _KEY[1:])


@query("f1_time_features", f"SELECT bidid, CAST(substr(timestamp, 9, 2) AS INT) AS hour, CAST(substr(timestamp, 11, 2) AS INT) AS minute, {_WD} AS weekday, CAST({_WD} >= 5 AS INT) AS is_weekend, CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 20 AS INT) AS is_peak_hour, round(sin(2*pi()*hour/24), 6) + 0.0 AS hour_sin, round(cos(2*pi()*hour/24), 6) + 0.0 AS hour_cos FROM bids")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(f.add_time_features(bids(spark, sf_dir).select("bidid", "timestamp")).drop("timestamp"))


@query("f2_weekday_counts", f"SELECT {_WD} AS weekday, CAST(count(*) AS BIGINT) AS n FROM bids GROUP BY 1")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.add_time_features(bids(spark, sf_dir).select("timestamp")).groupBy("weekday").agg(F.count("*").alias("n"))


@query("f3_season", "SELECT bidid, CASE WHEN substr(timestamp, 5, 2) = '06' THEN 2 ELSE 3 END AS season_by_month FROM bids")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids(spark, sf_dir).select("bidid", f.season_of().alias("season_by_month"))


@query("f4_f5_slot_features", f"SELECT bidid, CAST(slotwidth AS DOUBLE)*slotheight AS slot_area, round(ln(1 + CAST(slotwidth AS DOUBLE)*slotheight), 6) AS slot_area_log, round_even(slotwidth / CAST(CASE WHEN slotheight = 0 THEN 1 ELSE slotheight END AS DOUBLE), 2) AS slot_aspect_ratio, {_GROUP} AS slot_size_group FROM bids")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(f.add_slot_features(bids(spark, sf_dir).select("bidid", "slotwidth", "slotheight")).drop("slotwidth", "slotheight"))


@query("f6_bid_floor_ratio", "SELECT bidid, least(greatest(round_even(bidprice / CAST(CASE WHEN slotprice = 0 THEN 1 ELSE slotprice END AS DOUBLE), 3), 0.0), 100.0) AS bid_floor_ratio FROM bids")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.add_bid_floor_ratio(bids(spark, sf_dir)).select("bidid", "bid_floor_ratio")


def _horner(c: str, n: int) -> str:
    part = lambda k: f"CAST('0x' || substr(md5({c} || '_42'), {1 + 8 * k}, 8) AS BIGINT)"
    out = f"({part(0)} % {n})"
    for k in range(1, 4):
        out = f"(({out} * 4294967296 + {part(k)}) % {n})"
    return f"CAST(coalesce({out} + 1, 0) AS BIGINT)"


@query("f7_hash_buckets", f"SELECT bidid, {_horner('domain', 10000)} AS domain_hash, {_horner('creative', 10000)} AS creative_hash FROM bids")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.add_hash_buckets(bids(spark, sf_dir), ["domain", "creative"], 10_000).select("bidid", "domain_hash", "creative_hash")


@query("f8_frequency_encoding", "SELECT bidid, CAST(CASE WHEN domain IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY domain) END AS BIGINT) AS domain_freq, round(ln(1 + CASE WHEN domain IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY domain) END), 6) AS domain_freq_log FROM bids")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(f.add_frequency(bids(spark, sf_dir).select("bidid", "domain"), "domain").drop("domain"))


@query("f9_frequency_group", ", g AS (SELECT *, count(*) OVER (PARTITION BY region) AS rf FROM bids), e AS (SELECT quantile_cont(rf, 0.25) AS a, quantile_cont(rf, 0.5) AS b, quantile_cont(rf, 0.75) AS c FROM g) SELECT region_group, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN rf <= a THEN 'low' WHEN rf <= b THEN 'medium' WHEN rf <= c THEN 'high' ELSE 'very_high' END AS region_group FROM g, e) GROUP BY 1")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = f.add_frequency(bids(spark, sf_dir).select("bidid", "region"), "region")
    return f.add_frequency_group(counted, "region_freq", "region_group").groupBy("region_group").agg(F.count("*").alias("n"))


@query("f10_f21_catalogue", "SELECT feature, CAST(v AS BIGINT) + 2 AS vocab_size FROM (UNPIVOT (SELECT max(region) AS region, max(city) AS city, max(adexchange) AS adexchange, max(slotwidth) AS slotwidth, max(slotheight) AS slotheight, max(slotvisibility) AS slotvisibility, max(slotformat) AS slotformat, max(advertiser) AS advertiser, max(hour) AS hour, max(minute) AS minute FROM bids) ON region, city, adexchange, slotwidth, slotheight, slotvisibility, slotformat, advertiser, hour, minute INTO NAME feature VALUE v)")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.catalogue(bids(spark, sf_dir)).where("kind = 'categorical'").select("feature", "vocab_size")


_PLAIN = "bidid, day, season, timestamp, region, city, adexchange, advertiser, domain, creative, slotwidth, slotheight, slotvisibility, slotformat, slotprice, bidprice, payprice, market_truth, win, click, conversion, usertag"
_ENGINEERED = f"""
SELECT {_PLAIN}, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b,
  CAST(substr(timestamp, 9, 2) AS INT) AS hour, CAST(substr(timestamp, 11, 2) AS INT) AS minute, {_WD} AS weekday, CAST({_WD} >= 5 AS INT) AS is_weekend,
  CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 17 AND 20 AS INT) AS is_peak_hour, round(sin(2*pi()*hour/24), 6) + 0.0 AS hour_sin, round(cos(2*pi()*hour/24), 6) + 0.0 AS hour_cos,
  CAST(slotwidth AS DOUBLE)*slotheight AS slot_area, round(ln(1 + CAST(slotwidth AS DOUBLE)*slotheight), 6) AS slot_area_log, round_even(slotwidth / CAST(slotheight AS DOUBLE), 2) AS slot_aspect_ratio, {_GROUP} AS slot_size_group,
  least(greatest(round_even(bidprice / CAST(CASE WHEN slotprice = 0 THEN 1 ELSE slotprice END AS DOUBLE), 3), 0.0), 100.0) AS bid_floor_ratio,
  {_horner('domain', 10000)} AS domain_hash, {_horner('creative', 10000)} AS creative_hash,
  CAST(CASE WHEN domain IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY domain) END AS BIGINT) AS domain_freq,
  round(ln(1 + CASE WHEN domain IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY domain) END), 6) AS domain_freq_log,
  CAST(count(*) OVER (PARTITION BY creative) AS BIGINT) AS creative_freq, round(ln(1 + count(*) OVER (PARTITION BY creative)), 6) AS creative_freq_log
FROM bids"""


@query("f11_engineered", _ENGINEERED)
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(f.engineer(bids(spark, sf_dir)))


@query("f12_z_scores", ", s AS (SELECT avg(slotprice) AS ma, greatest(stddev_pop(slotprice), 1e-8) AS sa, avg(bidprice) AS mb, greatest(stddev_pop(bidprice), 1e-8) AS sb FROM bids) SELECT bidid, round((slotprice - ma) / sa, 6) + 0.0 AS slotprice, round((bidprice - mb) / sb, 6) + 0.0 AS bidprice FROM bids, s")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).select("bidid", "slotprice", "bidprice")
    return r6(f.z_score(df, f.normalisation_stats(df, ["slotprice", "bidprice"]), ["slotprice", "bidprice"]))


@query("f13_f14_codes", ", d AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS code FROM (SELECT DISTINCT domain FROM bids WHERE domain IS NOT NULL)) SELECT bidid, CAST(coalesce(code, -1) AS INT) AS domain_code, CAST(greatest(coalesce(code, -1), 0) AS INT) AS clipped, coalesce(slotvisibility, 0) AS slotvisibility FROM bids LEFT JOIN d USING (domain)")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = f.code_strings(f.zero_fill(bids(spark, sf_dir).select("bidid", "domain", "slotvisibility"), ["slotvisibility"]), ["domain"])
    return df.select("bidid", "domain_code", F.greatest("domain_code", F.lit(0)).alias("clipped"), "slotvisibility")


@query("f15_one_hot", "SELECT bidid, " + ", ".join(f"CAST({c} = {v} AS DOUBLE) AS {c}_{v}" for c, v in (("adexchange", 1), ("adexchange", 2), ("adexchange", 3), ("slotformat", 0), ("slotformat", 1), ("slotformat", 5))) + ", CAST(slotprice AS DOUBLE) AS slotprice, CAST(bidprice AS DOUBLE) AS bidprice FROM bids")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    hot = f.one_hot(bids(spark, sf_dir), ["adexchange", "slotformat"], ["slotprice", "bidprice"])
    names = ["adexchange_1", "adexchange_2", "adexchange_3", "slotformat_0", "slotformat_1", "slotformat_5", "slotprice", "bidprice"]
    flat = hot.select("bidid", vector_to_array("features").alias("x"))
    return flat.select("bidid", *[F.col("x")[k].alias(n) for k, n in enumerate(names)])


@query("f16_taxonomy", f", t AS (SELECT bidid, {_KIND} AS taxonomy FROM bids) SELECT taxonomy, CASE taxonomy WHEN 'branding' THEN 0 WHEN 'retargeting' THEN 1 WHEN 'mixed' THEN 2 ELSE -1 END AS taxonomy_code, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1, 2")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.add_taxonomy(bids(spark, sf_dir)).groupBy("taxonomy", "taxonomy_code").agg(F.count("*").alias("n"))


@query("f17_quality_flags", ", d AS (SELECT domain, count(*) AS n, sum(win) AS w, sum(click) AS c FROM bids WHERE domain IS NOT NULL GROUP BY 1), l AS (SELECT domain FROM d ORDER BY n DESC, domain LIMIT 10) SELECT bidid, CASE WHEN n >= 20 AND w = 0 THEN 'zero_win' WHEN w >= 20 AND c = 0 THEN 'zero_click' ELSE 'normal' END AS domain_tier, CAST(slotformat = 5 AS INT) AS is_popup, CAST(slotvisibility = 255 AS INT) AS visibility_unknown, CAST(win = 1 AND slotprice > 0 AND payprice = slotprice AS INT) AS floor_binding, CASE WHEN l.domain IS NOT NULL THEN bids.domain ELSE 'other' END AS domain_group FROM bids LEFT JOIN d ON bids.domain = d.domain LEFT JOIN l ON bids.domain = l.domain")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.quality_flags(bids(spark, sf_dir)).select("bidid", "domain_tier", "is_popup", "visibility_unknown", "floor_binding", "domain_group")


@query("f18_effect_labels", ", a AS (SELECT advertiser, avg(CASE WHEN win = 1 THEN slotprice END) AS m1, avg(CASE WHEN win = 0 THEN slotprice END) AS m0, var_samp(CASE WHEN win = 1 THEN slotprice END) AS v1, var_samp(CASE WHEN win = 0 THEN slotprice END) AS v0 FROM bids GROUP BY 1), d AS (SELECT advertiser, (m1 - m0) / sqrt((v1 + v0) / 2) AS d FROM a) SELECT advertiser, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM d")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    won, lost = F.when(F.col("win") == 1, F.col("slotprice")), F.when(F.col("win") == 0, F.col("slotprice"))
    d = bids(spark, sf_dir).groupBy("advertiser").agg(((F.avg(won) - F.avg(lost)) / F.sqrt((F.var_samp(won) + F.var_samp(lost)) / 2)).alias("d"))
    return r6(d.withColumn("label", effect_label("d")))


@query("f19_subpopulations", "SELECT CAST(sum(win) AS BIGINT) AS won, CAST(count(*) FILTER (win = 1 AND payprice > 0) AS BIGINT) AS paid, CAST(count(*) FILTER (advertiser IN (1458, 3386)) AS BIGINT) AS chosen, CAST(count(*) FILTER (domain IS NOT NULL AND isfinite(p_a) AND isfinite(p_b)) AS BIGINT) AS complete FROM bids")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.col("domain").isNotNull() & ~F.isnan("p_a") & ~F.isnan("p_b")
    return bids(spark, sf_dir).agg(F.count_if(F.col("win") == 1).alias("won"), F.count_if((F.col("win") == 1) & (F.col("payprice") > 0)).alias("paid"), F.count_if(F.col("advertiser").isin(1458, 3386)).alias("chosen"), F.count_if(finite).alias("complete"))


@query("f20_cross_entropy", ", s AS (UNPIVOT (SELECT bidid, click, win, p_a, p_b FROM bids) ON p_a, p_b INTO NAME model VALUE p) SELECT model, round(avg(-ln(CASE WHEN click = 1 THEN p ELSE 1 - p END)), 6) AS bce, round(avg(-ln(CASE WHEN click = 1 THEN p ELSE 1 - p END) * CASE WHEN click = 1 THEN 5.0 ELSE 1.0 END), 6) AS weighted, round(avg(-ln(CASE WHEN click = 1 THEN p ELSE 1 - p END) * pow(1 - CASE WHEN click = 1 THEN p ELSE 1 - p END, 2)), 6) AS focal FROM s WHERE win = 1 GROUP BY 1")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = scores(bids(spark, sf_dir)).where("win = 1")
    return r6(won.groupBy("model").agg(F.avg(cross_entropy("p", "click")).alias("bce"), F.avg(cross_entropy("p", "click", pos_weight=5.0)).alias("weighted"), F.avg(cross_entropy("p", "click", focal_gamma=2.0)).alias("focal")))


@query("p1_temporal_split", ", o AS (SELECT *, row_number() OVER (ORDER BY timestamp, bidid) - 1 AS plc, count(*) OVER () AS n FROM bids) SELECT bidid, CASE WHEN plc < floor(n*0.7) THEN 'train' WHEN plc < floor(n*0.85) THEN 'val' ELSE 'test' END AS split, bidprice, domain FROM o")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.split_temporal(bids(spark, sf_dir), ["timestamp", "bidid"]).select("bidid", "split", "bidprice", "domain")


@query("p2_split_by_days", "SELECT split, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN day % 10 IN (1, 2, 3, 4) THEN 'train' WHEN day % 10 IN (5, 6) THEN 'val' WHEN day % 10 IN (7, 8) THEN 'test' END AS split FROM bids) WHERE split IS NOT NULL GROUP BY 1")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).withColumn("day", (F.col("day") % 10).cast("int"))
    return f.split_days(df, [1, 2, 3, 4], [5, 6], [7, 8]).groupBy("split").agg(F.count("*").alias("n"))


@query("p3_fair_split", f"{_SPLIT} SELECT advertiser, split, CAST(count(*) AS BIGINT) AS n, CAST(sum(win) AS BIGINT) AS wins, CAST(sum(click) AS BIGINT) AS clicks FROM splits GROUP BY 1, 2")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir).groupBy("advertiser", "split").agg(F.count("*").alias("n"), F.sum("win").alias("wins"), F.sum("click").alias("clicks"))


@query("p4_vocabulary_audit", f"{_SPLIT}, v AS (SELECT DISTINCT split, domain FROM splits), t AS (SELECT domain FROM v WHERE split = 'train') SELECT split, CAST(count(*) AS BIGINT) AS n_values, CAST(count(*) FILTER (domain IN (SELECT domain FROM t WHERE domain IS NOT NULL)) AS BIGINT) AS shared, CAST(count(*) = count(*) FILTER (domain IN (SELECT domain FROM t WHERE domain IS NOT NULL)) AS INT) AS is_subset FROM v GROUP BY 1")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.vocabulary_audit(_splits(spark, sf_dir), "domain")


@query("p5_stratified_sample", f"{hash_sql('hx', 'bids', 'bidid', 42)} SELECT win, CAST(count(*) AS BIGINT) AS n FROM bids JOIN hx USING (bidid) WHERE {uniform_sql()} < 5000 / CAST((SELECT count(*) FROM bids) AS DOUBLE) GROUP BY 1")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    got = f.stratified_sample(df, "win", 5_000).groupBy("win").agg(F.count("*").alias("n"))
    return got


@query("p6_keep_positives", "SELECT click, CASE WHEN click = 1 THEN count(*) ELSE least(count(*), greatest(0, 3000 - (SELECT count(*) FROM bids WHERE click = 1))) END AS n FROM bids GROUP BY 1")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each label are kept; 0 where positives alone fill the table."""
    df = bids(spark, sf_dir)
    counts = f.keep_positives(df, "click", 3_000).groupBy("click").agg(F.count("*").alias("n"))
    return df.select("click").distinct().join(counts, "click", "left").select("click", F.coalesce("n", F.lit(0)).alias("n"))


_FOLDS = f"""{hash_sql('hx', 'bids', 'bidid', 42)},
fo AS (SELECT click, {fold_sql(5)} AS plain, CAST(row_number() OVER (PARTITION BY click, h // CAST('1048576' AS UHUGEINT) % CAST('64' AS UHUGEINT) ORDER BY {signed()}, bidid) % 5 AS INT) AS even FROM bids JOIN hx USING (bidid))
SELECT 'plain' AS kind, plain AS fold, CAST(count(*) AS BIGINT) AS n, CAST(sum(click) AS BIGINT) AS clicks FROM fo GROUP BY 2
UNION ALL SELECT 'stratified', even, CAST(count(*) AS BIGINT), CAST(sum(click) AS BIGINT) FROM fo GROUP BY 2"""


@query("p7_folds", _FOLDS)
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = f.add_fold(bids(spark, sf_dir), 5).groupBy("fold").agg(F.count("*").alias("n"), F.sum("click").alias("clicks")).withColumn("kind", F.lit("plain"))
    even = f.add_fold(bids(spark, sf_dir), 5, label="click").groupBy("fold").agg(F.count("*").alias("n"), F.sum("click").alias("clicks")).withColumn("kind", F.lit("stratified"))
    return plain.unionByName(even)


_REGION = ", rs AS (SELECT region, count(*) AS n_bids, sum(win) AS n_wins, sum(click) AS n_clicks, sum(win) / CAST(count(*) AS DOUBLE) AS win_rate, sum(click) / CAST(greatest(sum(win), 1) AS DOUBLE) AS ctr FROM splits WHERE split = 'train' GROUP BY 1)"


@query("j1_region_stats", f"{_SPLIT}{_REGION} SELECT region, CAST(n_bids AS BIGINT) AS n_bids, CAST(n_wins AS BIGINT) AS n_wins, CAST(n_clicks AS BIGINT) AS n_clicks, round(win_rate, 6) AS win_rate, round(ctr, 6) AS ctr FROM rs")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(f.region_stats(_splits(spark, sf_dir).where("split = 'train'")))


@query("j2_region_ctr", f"{_SPLIT}{_REGION} SELECT bidid, round(coalesce(ctr, (SELECT avg(ctr) FROM rs)), 6) AS region_ctr FROM splits LEFT JOIN rs USING (region) WHERE split <> 'train'")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _splits(spark, sf_dir)
    return r6(f.join_region_ctr(s.where("split <> 'train'"), f.region_stats(s.where("split = 'train'"))).select("bidid", "region_ctr"))


_MARKET = f", sg AS (SELECT *, {_GROUP} AS slot_size_group FROM splits), ms AS (SELECT adexchange, slot_size_group, avg(payprice) AS market_mean, coalesce(stddev_samp(payprice), 0.0) AS market_std, count(*) AS market_n FROM sg WHERE split = 'train' AND win = 1 GROUP BY 1, 2)"


@query("j3_market_stats", f"{_SPLIT}{_MARKET} SELECT adexchange, slot_size_group, round(market_mean, 6) AS market_mean, round(market_std, 6) AS market_std, CAST(market_n AS BIGINT) AS market_n FROM ms")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(f.market_stats(f.add_slot_features(_splits(spark, sf_dir).where("split = 'train'"))))


@query("j4_market_joined", f"{_SPLIT}{_MARKET} SELECT bidid, round(coalesce(market_mean, (SELECT avg(market_mean) FROM ms)), 6) AS market_mean, round(coalesce(market_std, (SELECT avg(market_std) FROM ms)), 6) AS market_std FROM sg LEFT JOIN ms USING (adexchange, slot_size_group) WHERE split = 'test'")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = f.add_slot_features(_splits(spark, sf_dir))
    return r6(f.join_market_stats(s.where("split = 'test'"), f.market_stats(s.where("split = 'train'"))).select("bidid", "market_mean", "market_std"))


@query("j5_normalisation", f"{_SPLIT} SELECT round(avg(slotprice), 6) AS slotprice_mean, round(greatest(stddev_pop(slotprice), 1e-8), 6) AS slotprice_std, round(avg(bidprice), 6) AS bidprice_mean, round(greatest(stddev_pop(bidprice), 1e-8), 6) AS bidprice_std FROM splits WHERE split = 'train'")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(f.normalisation_stats(_splits(spark, sf_dir).where("split = 'train'"), ["slotprice", "bidprice"]))


@query("j6_target_encoding", f"{_SPLIT}, t AS (SELECT *, bidid % 5 AS fold FROM splits WHERE split = 'train'), g AS (SELECT avg(win) AS g FROM t), c AS (SELECT domain, fold, sum(win) AS s, count(*) AS n FROM t GROUP BY 1, 2), o AS (SELECT domain, fold, sum(s) OVER (PARTITION BY domain) - s AS s, sum(n) OVER (PARTITION BY domain) - n AS n FROM c), wh AS (SELECT domain, sum(win) AS s, count(*) AS n FROM t GROUP BY 1) SELECT bidid, round(CASE WHEN o.n > 0 THEN (o.s + 10*g) / (o.n + 10) ELSE g END, 6) AS domain_te FROM g, t JOIN o ON t.domain IS NOT DISTINCT FROM o.domain AND t.fold = o.fold UNION ALL SELECT bidid, round(CASE WHEN wh.n > 0 THEN (wh.s + 10*g) / (wh.n + 10) ELSE g END, 6) FROM g, splits LEFT JOIN wh ON splits.domain IS NOT DISTINCT FROM wh.domain WHERE split = 'val'")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = kept(_splits(spark, sf_dir).select("bidid", "domain", "win", "split"), "split")
    train, val = f.target_encode(s.where("split = 'train'").withColumn("fold", F.col("bidid") % 5), s.where("split = 'val'"), "domain", "win")
    return r6(train.select("bidid", "domain_te").unionByName(val.select("bidid", "domain_te")))
