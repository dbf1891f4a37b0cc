"""Queries of ranking and calibration (M), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators import metrics as m
from gavel.operators.order import add_place
from gavel.plans.twins import fold_sql, hash_sql, monotone_sql
from gavel.registry import query, r6
from gavel.sources.logs import kept
from gavel.tables import bids, scores

_SC = ", sc AS (SELECT * FROM (UNPIVOT (SELECT * FROM bids) ON p_a, p_b INTO NAME model VALUE p) WHERE win = 1)"


def auc_sql(keys: str, src: str = "sc", y: str = "click", p: str = "p", name: str = "au") -> str:
    return f", {name}0 AS (SELECT {keys}, {p} AS s, CAST(sum({y}) AS DOUBLE) AS pos, CAST(sum(1 - {y}) AS DOUBLE) AS neg FROM {src} GROUP BY ALL), {name}1 AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM {name}0), {name} AS (SELECT {keys}, sum(pos*(nb + neg/2)) / nullif(sum(pos)*sum(neg), 0) AS auc FROM {name}1 GROUP BY {keys})"


def ece_sql(keys: str, src: str = "sc", name: str = "ec") -> str:
    return f", {name}0 AS (SELECT {keys}, floor(p*10) AS b, count(*) AS n, abs(avg(p) - avg(click)) AS g FROM {src} WHERE p < 1 GROUP BY ALL), {name} AS (SELECT {keys}, sum(n*g)/sum(n) AS ece FROM {name}0 GROUP BY {keys})"


def _won(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(bids(spark, sf_dir)).where("win = 1")


@query("m1_auc", f"{_SC}{auc_sql('model')} SELECT model, round(auc, 6) AS auc FROM au")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.auc(_won(spark, sf_dir), "model"))


@query("m2_m3_calibration_errors", f"{_SC}{ece_sql('model')} SELECT ec.model, round(ece, 6) AS ece, round(i, 6) AS ieb FROM ec JOIN (SELECT model, abs(avg(p) - avg(click)) / greatest(avg(click), 1e-8) AS i FROM sc GROUP BY 1) x ON ec.model = x.model")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = _won(spark, sf_dir)
    return r6(m.ece(won, "model").join(won.groupBy("model").agg(m.ieb().alias("ieb")), "model"))


@query("m4_m5_bundle", f"{_SC}{auc_sql('model')}{ece_sql('model')}, g AS (SELECT model, count(*) AS n, avg(-ln(CASE WHEN click = 1 THEN p ELSE 1 - p END)) AS log_loss, avg(CAST((p >= 0.03) = (click = 1) AS INT)) AS accuracy, sum(CAST(p >= 0.03 AND click = 1 AS INT)) AS tp, sum(CAST(p >= 0.03 AND click = 0 AS INT)) AS fp, sum(CAST(p < 0.03 AND click = 1 AS INT)) AS fn, abs(avg(p) - avg(click)) / avg(click) AS ieb, avg((p - click)*(p - click)) AS brier FROM sc GROUP BY 1) SELECT g.model, CAST(n AS BIGINT) AS n, round(log_loss, 6) AS log_loss, round(accuracy, 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2*tp / CAST(2*tp + fp + fn AS DOUBLE), 6) AS f1, round(ieb, 6) AS ieb, round(brier, 6) AS brier, round(auc, 6) AS auc, round(ece, 6) AS ece FROM g JOIN au ON g.model = au.model JOIN ec ON g.model = ec.model")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.bundle(_won(spark, sf_dir), "model", cut=0.03))


@query("m5_mean_gap", f"{_SC}, g AS (SELECT model, floor(p*100) AS b, abs(avg(p) - avg(click)) AS gap FROM sc WHERE p < 1 GROUP BY 1, 2) SELECT model, round(avg(gap), 6) AS mean_gap, CAST(count(*) AS BIGINT) AS n_bins FROM g GROUP BY 1")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.mean_gap(_won(spark, sf_dir), "model", n=100))


def _edges_sql(p: str, src: str) -> str:
    return f", ed AS (SELECT list_sort(list_distinct(quantile_cont({p}, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM {src})"


def _reliability_sql(keys: str, op: str = ">") -> str:
    return f"{_SC}{_edges_sql('p', 'sc')}, rb AS (SELECT {keys}, len(list_filter(e[2:len(e)-1], lambda x: p {op} x)) AS b, count(*) AS n, avg(p) AS mean_p, avg(click) AS mean_y FROM sc, ed GROUP BY ALL), rt AS (SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY b) - 1 AS INT) AS bin, n, mean_p, mean_y, mean_p - mean_y AS bias FROM rb)"


@query("m6_m7_reliability", f"{_reliability_sql('model')} SELECT model, bin, CAST(n AS BIGINT) AS n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, round(bias, 6) AS bias FROM rt")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.reliability(_won(spark, sf_dir), "model"))


@query("m8_left_closed", f"{_reliability_sql('model', '>=')} SELECT model, round(sum(n*abs(bias))/sum(n), 6) AS quantile_ece, round(max(abs(bias)), 6) AS max_bias, CAST(count(*) AS BIGINT) AS n_bins FROM rt GROUP BY 1")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.quantile_ece(m.reliability(_won(spark, sf_dir), "model", left_closed=True), "model"))


@query("m9_slices", f"{_SC}{ece_sql('advertiser')} SELECT ec.advertiser, CAST(n AS BIGINT) AS n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y, round(mp - my, 6) AS bias, round(ece, 6) AS ece FROM ec JOIN (SELECT advertiser, count(*) AS n, avg(p) AS mp, avg(click) AS my FROM sc GROUP BY 1) x ON ec.advertiser = x.advertiser".replace("WHERE win = 1)", "WHERE win = 1 AND model = 'p_a')"))
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.slices(_won(spark, sf_dir).where("model = 'p_a'"), "advertiser"))


@query("m9_slice_summary", f"{_SC}, g AS (SELECT advertiser, count(*) AS n, abs(avg(p) - avg(click)) AS bias FROM sc WHERE model = 'p_a' GROUP BY 1) SELECT round(max(bias), 6) AS max_bias, round(sum(n*bias)/sum(n), 6) AS weighted_bias, CAST(count(*) AS BIGINT) AS n_slices FROM g")
def m9_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.slice_summary(m.slices(_won(spark, sf_dir).where("model = 'p_a'"), "advertiser")))


@query("m10_m17_summary", f"{_reliability_sql('model')} SELECT model, round(sum(n*abs(bias))/sum(n), 6) AS quantile_ece, round(max(abs(bias)), 6) AS max_bias, CAST(count(*) AS BIGINT) AS n_bins, CAST(count(*) FILTER (mean_p / nullif(mean_y, 0) < 0.8) AS BIGINT) AS under, CAST(count(*) FILTER (mean_p / nullif(mean_y, 0) > 1.25) AS BIGINT) AS over, CAST(count(*) FILTER (bias > 0) AS BIGINT) AS positive, CAST(count(*) FILTER (bias < 0) AS BIGINT) AS negative FROM rt GROUP BY 1")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = m.reliability(_won(spark, sf_dir), "model")
    return r6(m.quantile_ece(table, "model").join(m.decile_off(table, "model"), "model"))


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids(spark, sf_dir).where("win = 1").withColumn("p", F.col("p_a"))


# Won bids with score x, label y and weight w; with folds of the Spark hash; and what each fold learns from.
_WON1 = ", wn AS (SELECT *, p_a AS x, click AS y, CAST(1 AS DOUBLE) AS w FROM bids WHERE win = 1)"
_FOLDED = f"{_WON1}{hash_sql('hx', 'wn', 'bidid', 42)}, fd AS (SELECT wn.*, {fold_sql(5)} AS f FROM wn JOIN hx USING (bidid)), ks AS (SELECT CAST(unnest(range(5)) AS INT) AS f), tr AS (SELECT ks.f, x, y, w FROM ks JOIN fd ON ks.f <> fd.f)"
_CROSS = f"{_FOLDED}{monotone_sql('mo', 'tr', 'fd', 'f')}"
_SEGMENTS = f"{_CROSS}, ts0 AS (SELECT advertiser, ks.f, x, y, w FROM ks JOIN fd ON ks.f <> fd.f), ts AS (SELECT * FROM ts0 QUALIFY sum(y) OVER (PARTITION BY advertiser, f) >= 5){monotone_sql('ms', 'ts', 'fd', 'advertiser', 'f')}, sg AS (SELECT fd.*, mo.g AS whole, coalesce(ms.g, mo.g) AS own FROM fd JOIN mo USING (f, x) LEFT JOIN ms USING (advertiser, f, x))"
_SEASONS = "tr2 AS (SELECT * FROM wn WHERE season = 2), te AS (SELECT * FROM wn WHERE season = 3)"
_IEB = "round(abs(avg({0}) - avg(click)) / greatest(avg(click), 1e-8), 6)"


@query("m11_m15_frozen_isotonic", f"{_WON1}, {_SEASONS}{monotone_sql('mf', 'tr2', 'te')} SELECT advertiser, {_IEB.format('x')} AS ieb_raw, {_IEB.format('g')} AS ieb_frozen, CAST(count(*) AS BIGINT) AS n FROM te JOIN mf USING (x) GROUP BY 1")
def m11(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _one(spark, sf_dir)
    got = m.isotonic(df.where("season = 2"), df.where("season = 3"))
    return r6(got.groupBy("advertiser").agg(m.ieb(p="p").alias("ieb_raw"), m.ieb(p="calibrated").alias("ieb_frozen"), F.count("*").alias("n")))


@query("m12_cross_fit_isotonic", f"{_CROSS} SELECT bidid, round(x, 6) AS p, round(g, 6) AS calibrated FROM fd JOIN mo USING (f, x)")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.cross_fit(_one(spark, sf_dir)).select("bidid", "p", "calibrated"))


@query("m13_segment_isotonic", f"{_SEGMENTS} SELECT bidid, advertiser, round(x, 6) AS p, round(own, 6) AS calibrated FROM sg")
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(_one(spark, sf_dir).select("bidid", "advertiser", "click", "p"), "won")
    return r6(m.segment_cross_fit(df, "advertiser", least=5).select("bidid", "advertiser", "p", "calibrated"))


@query("m14_averaged_isotonic", f"{_FOLDED}, wa AS (SELECT ks.f, p_a AS x FROM ks, (SELECT DISTINCT p_a FROM bids)){monotone_sql('mo', 'tr', 'wa', 'f')}, av AS (SELECT x, avg(g) AS g FROM mo GROUP BY 1) SELECT bidid, round(p_a, 6) AS p, round(g, 6) AS calibrated FROM bids JOIN av ON p_a = x")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).withColumn("p", F.col("p_a"))
    return r6(m.averaged_maps(df.where("win = 1"), df).select("bidid", "p", "calibrated"))


_WEIGHTED = f", ra AS (SELECT adexchange, advertiser, 1 / greatest(avg(win), 0.05) AS w FROM bids GROUP BY 1, 2), tw AS (SELECT p_a AS x, click AS y, w FROM bids JOIN ra USING (adexchange, advertiser) WHERE win = 1), wa AS (SELECT DISTINCT p_a AS x FROM bids){monotone_sql('mo', 'tw', 'wa')}"


@query("m16_weighted_isotonic", f"{_WEIGHTED} SELECT bidid, round(p_a, 6) AS p, round(g, 6) AS calibrated FROM bids JOIN mo ON p_a = x")
def m16(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).withColumn("p", F.col("p_a"))
    rates = df.groupBy("adexchange", "advertiser").agg(F.avg("win").alias("e"))
    won = df.where("win = 1").join(F.broadcast(rates), ["adexchange", "advertiser"]).withColumn("wt", 1 / F.greatest("e", F.lit(0.05)))
    return r6(m.isotonic(won, df, weight="wt").select("bidid", "p", "calibrated"))


@query("m18_m20_by_advertiser", f"{_SC}{auc_sql('advertiser')} SELECT au.advertiser, CAST(n AS BIGINT) AS n, round(i, 6) AS ieb, round(r, 6) AS rel_bias, round(auc, 6) AS auc FROM au JOIN (SELECT advertiser, count(*) AS n, abs(avg(p) - avg(click)) / greatest(avg(click), 1e-8) AS i, (avg(p) - avg(click)) / greatest(avg(click), 1e-8) AS r FROM sc GROUP BY 1) x ON au.advertiser = x.advertiser".replace("WHERE win = 1)", "WHERE win = 1 AND model = 'p_b')"))
def m18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.by_group(_won(spark, sf_dir).where("model = 'p_b'"), "advertiser"))


@query("m19_easy_negatives", f", s0 AS (SELECT * FROM (UNPIVOT (SELECT * FROM bids) ON p_a, p_b INTO NAME model VALUE p)), s1 AS (SELECT * FROM s0 WHERE win = 1){auc_sql('model', 's0', name='aa')}{auc_sql('model', 's1', name='ab')} SELECT aa.model, round(aa.auc, 6) AS auc_all, round(ab.auc, 6) AS auc_won, round(aa.auc - ab.auc, 6) AS gap FROM aa JOIN ab ON aa.model = ab.model")
def m19(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = scores(bids(spark, sf_dir))
    both = m.auc(every, "model").withColumnRenamed("auc", "auc_all").join(m.auc(every.where("win = 1"), "model").withColumnRenamed("auc", "auc_won"), "model")
    return r6(both.withColumn("gap", F.col("auc_all") - F.col("auc_won")))


@query("m20_without_one_advertiser", f"{_SC}, sx AS (SELECT * FROM sc WHERE advertiser <> 1458){auc_sql('model', 'sx')} SELECT model, round(auc, 6) AS auc FROM au")
def m20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.auc(_won(spark, sf_dir).where("advertiser <> 1458"), "model"))


@query("m21_funnel_metrics", ", fm AS (SELECT *, 1 AS z, bidprice / 300.0 AS pw, bidprice / 300.0 * p_a AS pj FROM bids), fw AS (SELECT * FROM fm WHERE win = 1)" + auc_sql("z", "fm", "win", "pw", "aw") + auc_sql("z", "fw", "click", "p_a", "ac") + auc_sql("z", "fm", "click", "pj", "aj") + " SELECT round(aw.auc, 6) AS win_auc, round(ac.auc, 6) AS ctr_auc, round(aj.auc, 6) AS wctr_auc FROM aw, ac, aj")
def m21(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).withColumn("pw", F.col("bidprice") / 300.0).withColumn("pj", F.col("pw") * F.col("p_a"))
    name = lambda t, n: t.withColumnRenamed("auc", n)
    return r6(name(m.auc(df, y="win", p="pw"), "win_auc").crossJoin(name(m.auc(df.where("win = 1"), p="p_a"), "ctr_auc")).crossJoin(name(m.auc(df, p="pj"), "wctr_auc")))


@query("m22_calibration_curve", f"{_SC} SELECT model, CAST(floor(p*100) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(p), 6) AS mean_p, round(avg(click), 6) AS mean_y FROM sc GROUP BY 1, 2 UNION ALL SELECT model, -1, CAST(count(*) AS BIGINT), round(avg(p), 6), round(avg(click), 6) FROM sc GROUP BY 1")
def m22(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = _won(spark, sf_dir)
    total = won.groupBy("model").agg(F.lit(-1).alias("bin"), F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("click").alias("mean_y"))
    return r6(m.equal_width(won, "model", n=100).unionByName(total.select("model", "bin", "n", "mean_p", "mean_y")))


@query("m23_roc_points", f"{_SC}, g AS (SELECT model, p, sum(click) AS a, sum(1 - click) AS b FROM sc GROUP BY 1, 2) SELECT model, round(p, 6) AS p, round(sum(a) OVER o / CAST(sum(a) OVER (PARTITION BY model) AS DOUBLE), 6) AS tpr, round(sum(b) OVER o / CAST(sum(b) OVER (PARTITION BY model) AS DOUBLE), 6) AS fpr FROM g WINDOW o AS (PARTITION BY model ORDER BY p DESC)")
def m23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.roc_points(_won(spark, sf_dir), "model"))


@query("m23_histogram", f"{_SC}, e AS (SELECT model, quantile_cont(p, 0.995) AS top FROM sc GROUP BY 1) SELECT sc.model, CAST(least(floor(p*20/top), 19) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM sc JOIN e ON sc.model = e.model WHERE p <= top GROUP BY 1, 2")
def m23h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.histogram(_won(spark, sf_dir), "model")


@query("m24_comparison", f"{_SC}{auc_sql('model')}, x AS (SELECT au.model, auc, i FROM au JOIN (SELECT model, abs(avg(p) - avg(click)) / avg(click) AS i FROM sc GROUP BY 1) y ON au.model = y.model) SELECT model, round(auc, 6) AS auc, round(i, 6) AS ieb, CAST(rank() OVER (ORDER BY auc DESC) = 1 AS INT) AS best_auc, CAST(rank() OVER (ORDER BY i) = 1 AS INT) AS best_ieb FROM x")
def m24(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = _won(spark, sf_dir)
    table = m.auc(won, "model").join(won.groupBy("model").agg(m.ieb().alias("ieb")), "model")
    return r6(m.best_flags(table, ["auc"], ["ieb"]))


@query("m25_b28_correlations", ", g AS (SELECT advertiser, adexchange, avg(p_a) AS x, avg(CASE WHEN win = 1 THEN click END) AS y FROM bids GROUP BY 1, 2), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM g) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r")
def m25(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bids(spark, sf_dir).groupBy("advertiser", "adexchange").agg(F.avg("p_a").alias("x"), F.avg(F.when(F.col("win") == 1, F.col("click"))).alias("y"))
    return r6(m.average_ranks(g, "x", "y").agg(F.corr("x", "y").alias("pearson"), F.corr("x_rank", "y_rank").alias("spearman")))


_REGIMES = f"""{_SEGMENTS}, {_SEASONS}{monotone_sql('mf', 'tr2', 'wn')},
al AS (SELECT 'raw' AS regime, click, x AS c FROM sg UNION ALL SELECT 'cross_fit', click, whole FROM sg UNION ALL SELECT 'segment', click, own FROM sg UNION ALL SELECT 'frozen', click, g FROM wn JOIN mf USING (x)){auc_sql('regime', 'al', p='c')}
SELECT regime, i AS ieb, n, round(auc, 6) AS auc FROM au JOIN (SELECT regime, {_IEB.format('c')} AS i, CAST(count(*) AS BIGINT) AS n FROM al GROUP BY 1) USING (regime)"""


@query("m26_regimes", _REGIMES)
def m26(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(_one(spark, sf_dir).select("bidid", "advertiser", "season", "click", "p"), "won")
    tables = {"raw": df.withColumn("calibrated", F.col("p")), "cross_fit": m.cross_fit(df), "segment": m.segment_cross_fit(df, "advertiser", least=5), "frozen": m.isotonic(df.where("season = 2"), df)}
    out = None
    for name, t in tables.items():
        got = t.select(F.lit(name).alias("regime"), "click", "calibrated")
        out = got if out is None else out.unionByName(got)
    rows = kept(out, "regimes")
    return r6(rows.groupBy("regime").agg(m.ieb(p="calibrated").alias("ieb"), F.count("*").alias("n")).join(m.auc(rows, "regime", p="calibrated"), "regime"))


_RANKED = """, c AS (SELECT abs(corr(hour, {p})) AS hour, abs(corr(slotprice, {p})) AS slotprice, abs(corr(bidprice, {p})) AS bidprice, abs(corr(region, {p})) AS region FROM bids), l AS (UNPIVOT c ON hour, slotprice, bidprice, region INTO NAME feature VALUE strength)"""


@query("x3_model_ranks", ", a AS (WITH z AS (SELECT 1)" + _RANKED.format(p="p_a") + " SELECT feature, rank() OVER (ORDER BY strength DESC) AS rk FROM l), b AS (WITH z AS (SELECT 1)" + _RANKED.format(p="p_b") + " SELECT feature, rank() OVER (ORDER BY strength DESC) AS rk FROM l) SELECT a.feature, CAST(a.rk AS INT) AS rank_a, CAST(b.rk AS INT) AS rank_b, CAST(abs(a.rk - b.rk) AS INT) AS apart FROM a JOIN b ON a.feature = b.feature")
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' tables of ranked features, joined by feature."""
    df = bids(spark, sf_dir)
    a, b = (m.feature_ranks(df, p, ["hour", "slotprice", "bidprice", "region"]) for p in ("p_a", "p_b"))
    both = a.withColumnRenamed("rank", "rank_a").join(b.withColumnRenamed("rank", "rank_b"), "feature")
    return both.select("feature", "rank_a", "rank_b", F.abs(F.col("rank_a") - F.col("rank_b")).alias("apart"))


@query("x4_aligned_predictions", ", o AS (SELECT click, p_b, row_number() OVER (ORDER BY timestamp, bidid) AS plc FROM bids), q AS (SELECT click AS other, p_a, row_number() OVER (ORDER BY timestamp, bidid) AS plc FROM bids) SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(click) AS BIGINT) AS labels, CAST(sum(other) AS BIGINT) AS stored_labels, round(sum(p_a*click), 6) AS score_on_clicks, round(corr(p_a, p_b), 6) AS correlation FROM o JOIN q USING (plc)")
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's scores, stored by position, beside the rows that they belong to; equal label sums show that they are aligned."""
    df, order = bids(spark, sf_dir), ["timestamp", "bidid"]
    stored = add_place(df.select(*order, "click", "p_a"), order, "place").select("place", F.col("click").alias("other"), "p_a")
    rows = add_place(df.select(*order, "click", "p_b"), order, "place")
    both = rows.join(stored, "place")
    return r6(both.agg(F.count("*").alias("n"), F.sum("click").alias("labels"), F.sum("other").alias("stored_labels"), F.sum(F.col("p_a") * F.col("click")).alias("score_on_clicks"), F.corr("p_a", "p_b").alias("correlation")))
