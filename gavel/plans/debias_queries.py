"""Queries of selection bias (D) and effects (C), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.functions.columns import fold
from gavel.operators import debias as d
from gavel.operators import effects as c
from gavel.operators.features import add_taxonomy, split_by_group
from gavel.plans.feature_queries import _KEY, _KIND
from gavel.plans.metric_queries import auc_sql
from gavel.registry import query, r6
from gavel.sources.logs import kept
from gavel.tables import bids

CPC = 10_000.0
# A propensity that both engines have: the win rate of the exchange and advertiser.
_E = ", pe AS (SELECT adexchange, advertiser, avg(win) AS e FROM bids GROUP BY 1, 2), be AS (SELECT bids.*, e, least(greatest(e, 0.01), 0.99) AS ec FROM bids JOIN pe ON bids.adexchange = pe.adexchange AND bids.advertiser = pe.advertiser)"


def _with_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    rates = df.groupBy("adexchange", "advertiser").agg(F.avg("win").alias("e"))
    return df.join(F.broadcast(rates), ["adexchange", "advertiser"])


@query("d1_cross_fit_propensity")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = d.cross_fit_propensity(bids(spark, sf_dir).select("bidid", "win", *d.FEATURES), kind="linear", calibrate=True)
    return r6(d.diagnose(kept(scored.select("win", "e"), "scored")), 4)


@query("d2_ensemble_propensity")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).select("bidid", "season", "advertiser", "win", *d.FEATURES)
    return r6(d.ensemble_propensity(df.where("season = 2"), df.where("season = 3")).groupBy("advertiser").agg(F.avg("e").alias("mean_e"), F.avg("win").alias("win_rate")), 4)


@query("d3_d17_single_model")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 80/20 fit, stored, loaded and applied to the held-out rows."""
    from pyspark.ml import PipelineModel

    from gavel.sources.logs import fresh

    df = bids(spark, sf_dir).withColumn("f", fold("bidid", 5))
    path = fresh(spark, "model")
    d.fit_probability(df.where("f > 0"), "win", kind="trees").write().save(path)
    scored = d.apply_probability(PipelineModel.load(path), df.where("f = 0").select("win", *d.FEATURES), "e")
    return r6(d.diagnose(kept(scored, "scored")), 4)


@query("d4_weights", f"{_E}, k AS (SELECT count(*) / greatest(sum(win / ec), 1e-8) AS k FROM be) SELECT bidid, round(win / ec * k, 6) AS w FROM be, k".replace(", k AS (SELECT count", ", kk AS (SELECT count").replace("FROM be, k", "FROM be, kk"))
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(d.win_weights(_with_e(spark, sf_dir)).select("bidid", "w"))


@query("d5_diagnosis", f"{_E}, bz AS (SELECT *, 1 AS z FROM be){auc_sql('z', 'bz', 'win', 'e')} SELECT round(avg(CAST(e > 0.1 AND e < 0.9 AS INT)), 6) AS overlap_10, round(avg(CAST(e > 0.05 AND e < 0.95 AS INT)), 6) AS overlap_05, round(avg(CAST(e < 0.01 AS INT)), 6) AS extreme_low, round(avg(CAST(e > 0.99 AS INT)), 6) AS extreme_high, round(sum(win/ec)*sum(win/ec)/sum(win/ec*win/ec), 4) AS ess, CAST(count(*) AS BIGINT) AS n, round(max(auc), 6) AS auc, round(sum(win/ec)*sum(win/ec)/sum(win/ec*win/ec)/count(*), 6) AS ess_ratio, CAST(max(auc) > 0.9 AS INT) AS violated FROM bz, au")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(r6(d.diagnose(_with_e(spark, sf_dir))).withColumn("ess", F.round("ess", 4)))


@query("d6_weight_statistics", f"{_E}, ww AS (SELECT win, win/ec AS w FROM be) SELECT round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, round(max(w), 6) AS most, round(sum(w)*sum(w)/sum(w*w), 4) AS ess, round(sum(w)*sum(w)/sum(w*w)/sum(win), 6) AS won_ess_ratio FROM ww")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = d.win_weights(_with_e(spark, sf_dir), normalise=False)
    return r6(d.weight_statistics(df).withColumn("ess", F.round("ess", 4)))


_SHIFT = ["slotprice", "bidprice", "hour", "region"]


@query("d7_covariate_shift", ", lg AS (UNPIVOT (SELECT win, CAST(slotprice AS DOUBLE) AS slotprice, CAST(bidprice AS DOUBLE) AS bidprice, CAST(hour AS DOUBLE) AS hour, CAST(region AS DOUBLE) AS region FROM bids) ON slotprice, bidprice, hour, region INTO NAME feature VALUE v), cv AS (SELECT feature, v, sum(win) AS a, sum(1 - win) AS b FROM lg GROUP BY 1, 2), ck AS (SELECT feature, abs(sum(a) OVER (PARTITION BY feature ORDER BY v) / CAST(sum(a) OVER (PARTITION BY feature) AS DOUBLE) - sum(b) OVER (PARTITION BY feature ORDER BY v) / CAST(sum(b) OVER (PARTITION BY feature) AS DOUBLE)) AS d FROM cv), md AS (SELECT feature, max(d) AS ks FROM ck GROUP BY 1), cd AS (SELECT feature, (avg(CASE WHEN win = 1 THEN v END) - avg(CASE WHEN win = 0 THEN v END)) / sqrt((var_samp(CASE WHEN win = 1 THEN v END) + var_samp(CASE WHEN win = 0 THEN v END)) / 2) AS cohens_d FROM lg GROUP BY 1) SELECT md.feature, round(ks, 6) AS ks, round(cohens_d, 6) AS cohens_d FROM md JOIN cd ON md.feature = cd.feature")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(d.covariate_shift(bids(spark, sf_dir), "win", _SHIFT).select("feature", "ks", "cohens_d"))


_CTR = "CAST(count(*) AS BIGINT) AS n, CAST(sum(win) AS BIGINT) AS n_wins, CAST(sum(click) AS BIGINT) AS n_clicks, round(sum(click) / CAST(greatest(sum(win), 1) AS DOUBLE), 6) AS naive_ctr, round(sum(click*win/ec) / greatest(sum(win/ec), 1e-8), 6) AS ipw_ctr, round(sum(click*win/ec) / count(*), 6) AS ht_ctr, round(sum(win/ec)*sum(win/ec) / greatest(sum(win/ec*win/ec), 1e-8), 4) AS ess"


@query("d8_bucket_ctr", f"{_E}, ed AS (SELECT list_sort(list_distinct(quantile_cont(ec, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS q FROM be) SELECT CAST(len(list_filter(q[2:len(q)-1], lambda x: ec > x)) AS INT) AS bucket, {_CTR} FROM be, ed GROUP BY 1 UNION ALL SELECT -1, {_CTR} FROM be")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(d.bucket_ctr(_with_e(spark, sf_dir)).withColumn("ess", F.round("ess", 4)))


@query("d9_subgroup_bias", f"{_E}, g AS (SELECT advertiser, count(*) AS n, sum(click) AS n_clicks, sum(click) / CAST(greatest(sum(win), 1) AS DOUBLE) AS a, sum(click*win/ec) / greatest(sum(win/ec), 1e-8) AS b FROM be GROUP BY 1 HAVING sum(click) >= 1), h AS (SELECT *, 100*(a - b)/greatest(b, 1e-8) AS bias FROM g) SELECT advertiser, CAST(n AS BIGINT) AS n, CAST(n_clicks AS BIGINT) AS n_clicks, round(a, 6) AS naive_ctr, round(b, 6) AS ipw_ctr, round(bias, 4) AS bias_pct, CAST((SELECT count(DISTINCT sign(bias)) FROM h) > 1 AS INT) AS mixed, round((SELECT max(abs(bias)) FROM h), 4) AS max_bias FROM h")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = d.subgroup_bias(_with_e(spark, sf_dir), "advertiser")
    return r6(got.withColumns({"bias_pct": F.round("bias_pct", 4), "max_bias": F.round("max_bias", 4)}))


@query("d10_feature_sensitivity")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(d.feature_sensitivity(bids(spark, sf_dir), {"price": ["bidprice", "slotprice"], "all": d.FEATURES}), 4)


@query("d11_clip_sensitivity", f"{_E}, cl AS (SELECT unnest([{{'lo': 0.01, 'hi': 0.99}}, {{'lo': 0.05, 'hi': 0.95}}, {{'lo': 0.3, 'hi': 0.5}}]) AS c) SELECT CAST(c.lo AS DOUBLE) AS lo, CAST(c.hi AS DOUBLE) AS hi, round(sum(click*win/least(greatest(e, c.lo), c.hi)) / sum(win/least(greatest(e, c.lo), c.hi)), 6) AS ipw_ctr, round(sum(win/least(greatest(e, c.lo), c.hi))*sum(win/least(greatest(e, c.lo), c.hi))/sum(win/least(greatest(e, c.lo), c.hi)*win/least(greatest(e, c.lo), c.hi)), 4) AS ess FROM be, cl GROUP BY 1, 2")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(d.clip_sensitivity(_with_e(spark, sf_dir), [(0.01, 0.99), (0.05, 0.95), (0.3, 0.5)]).withColumn("ess", F.round("ess", 4)))


@query("d12_bias_summary", f"{_E}, x AS (SELECT avg(click) AS naive, sum(click*least(greatest(1/e, 0.1), 10.0)) / sum(least(greatest(1/e, 0.1), 10.0)) AS ipw FROM be WHERE win = 1) SELECT round(naive, 6) AS naive, round(ipw, 6) AS ipw, round(naive - ipw, 6) AS bias, round(100*(naive - ipw)/ipw, 4) AS bias_pct FROM x")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(d.bias_summary(_with_e(spark, sf_dir)).withColumn("bias_pct", F.round("bias_pct", 4)))


@query("d13_propensity_correlation", f"{_E}, rk AS (SELECT adexchange, e, p_a, rank() OVER (PARTITION BY adexchange ORDER BY e) + (count(*) OVER (PARTITION BY adexchange, e) - 1) / 2.0 AS re, rank() OVER (PARTITION BY adexchange ORDER BY p_a) + (count(*) OVER (PARTITION BY adexchange, p_a) - 1) / 2.0 AS rp FROM be) SELECT adexchange, round(corr(e, p_a), 6) AS pearson, round(corr(re, rp), 6) AS spearman, round(avg(CAST(e > 0.1 AND e < 0.9 AND p_a > 0.001 AS INT)), 6) AS joint_overlap FROM rk GROUP BY 1")
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(d.propensity_correlation(_with_e(spark, sf_dir), "e", "p_a", "adexchange"))


@query("d14_d15_click_models")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(_with_e(spark, sf_dir).select("advertiser", "win", "click", "e", *d.FEATURES), "rows")
    got = d.doubly_robust(d.click_models(rows))
    return r6(got.groupBy("advertiser").agg(F.avg("p_biased").alias("biased"), F.avg("p_ipw").alias("ipw"), F.avg("p_dr").alias("dr"), F.avg("click").alias("click_rate")), 4)


def _task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that D16 uses, stored once, with their splits."""
    rows = kept(bids(spark, sf_dir).select(*dict.fromkeys([*_KEY, *d.FEATURES, "win", "click"])), "rows")
    return split_by_group(rows, "advertiser", _KEY[1:])


@query("d16_baselines")
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(d.baselines(_task_rows(spark, sf_dir)), 4)


@query("d16_metrics")
def d16m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of the baselines on each split."""
    return r6(d.baseline_metrics(_task_rows(spark, sf_dir)), 4)


@query("d16_importances")
def d16i(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature counts for in the baselines, with ranks that X3 compares."""
    return r6(d.baseline_importances(_task_rows(spark, sf_dir)), 4)


@query("d18_segment_weights", f"{_E}, r0 AS (SELECT avg(win) AS r FROM bids) SELECT hour, adexchange, round(avg(least(greatest(r / least(greatest(e, 0.05), 0.95), 0.5), 5.0)), 6) AS weight, CAST(count(*) AS BIGINT) AS n FROM be, r0 GROUP BY 1, 2")
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(d.segment_weights(_with_e(spark, sf_dir), ["hour", "adexchange"]))


_L = "-ln(CASE WHEN click = 1 THEN p_a ELSE 1 - p_a END)"


@query("d19_tower_losses", f"{_E}, x AS (SELECT *, {_L} AS l, greatest(e, 0.05) AS eg, e*p_a AS j FROM be) SELECT round(avg(-ln(CASE WHEN win = 1 THEN e ELSE 1 - e END)), 6) AS win_loss, round(avg(CASE WHEN win = 1 THEN l END), 6) AS ctr_loss, round(avg(win/eg*l), 6) AS ipw_loss, round(avg(-ln(CASE WHEN click = 1 THEN j ELSE 1 - j END)), 6) AS joint_loss, round(avg(CASE WHEN win = 1 THEN (l - p_b)*(l - p_b) END), 6) AS imputation_loss, round(avg(p_b + win/eg*(l - p_b)), 6) AS dr_loss FROM x")
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(d.tower_losses(_with_e(spark, sf_dir), "e", "p_a", "p_b"))


# --- effects ------------------------------------------------------------------------

_T = f", tt AS (SELECT *, p_a*{CPC} AS v, CASE WHEN win = 1 THEN payprice ELSE 0 END AS payment, CASE WHEN win = 1 THEN p_a*{CPC} - payprice ELSE 0 END AS surplus, {_KIND} AS taxonomy FROM bids), mx AS (SELECT advertiser, max(bidprice) AS hi, min(bidprice) AS lo FROM bids GROUP BY 1 HAVING count(DISTINCT bidprice) >= 2), ar AS (SELECT tt.*, CAST(bidprice = hi AS INT) AS arm, concat_ws('_', taxonomy, adexchange, CAST(least(floor(hour/6), 3) AS INT)) AS stratum FROM tt JOIN mx ON tt.advertiser = mx.advertiser AND (bidprice = hi OR bidprice = lo))"


_ARM_COLUMNS = ["bidid", "day", "hour", "region", "adexchange", "advertiser", "slotwidth", "slotheight", "slotprice", "bidprice", "win", "click", "payment", "v", "surplus", "taxonomy", "arm", "stratum"]


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = add_taxonomy(c.treatment_table(c.varied(bids(spark, sf_dir)), CPC))
    return c.arms(df).withColumn("stratum", c.strata()).select(*_ARM_COLUMNS)


@query("c1_c2_treatment_table", f"{_T} SELECT advertiser, arm, CAST(count(*) AS BIGINT) AS n, round(avg(win), 6) AS win, round(avg(payment), 6) AS payment, round(avg(surplus), 6) AS surplus FROM ar GROUP BY 1, 2")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_arms(spark, sf_dir).groupBy("advertiser", "arm").agg(F.count("*").alias("n"), F.avg("win").alias("win"), F.avg("payment").alias("payment"), F.avg("surplus").alias("surplus")))


def _strata_sql(outcome: str) -> str:
    hi, lo = f"CASE WHEN arm = 1 THEN {outcome} END", f"CASE WHEN arm = 0 THEN {outcome} END"
    return f"{_T}, sg AS (SELECT stratum, avg({hi}) - avg({lo}) AS cate, sqrt(var_pop({hi})/count({hi}) + var_pop({lo})/count({lo})) AS se, count({hi}) AS n1, count({lo}) AS n0 FROM ar GROUP BY 1 HAVING count({hi}) >= 5 AND count({lo}) >= 5)"


@query("c3_c4_stratified", f"{_strata_sql('surplus')} SELECT stratum, round(cate, 6) AS cate, round(se, 6) AS se, CAST(n1 AS BIGINT) AS n1, CAST(n0 AS BIGINT) AS n0 FROM sg")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.stratified_effect(_arms(spark, sf_dir), "surplus"))


@query("c4_average_effect", f"{_strata_sql('win')} SELECT round(sum((n1+n0)*cate)/sum(n1+n0), 6) AS ate, round(sqrt(sum((n1+n0)*se*se)/sum(n1+n0)), 6) AS se_ref, round(sqrt(sum((n1+n0)*(n1+n0)*se*se))/sum(n1+n0), 6) AS se, CAST(count(*) AS BIGINT) AS n_strata FROM sg")
def c4a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.average_effect(c.stratified_effect(_arms(spark, sf_dir), "win")))


@query("c5_t_learner")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.effect_summary(c.t_learner(_arms(spark, sf_dir), "surplus"), "taxonomy"), 4)


_D = lambda o: f"avg(CASE WHEN arm = 1 THEN {o} END) - avg(CASE WHEN arm = 0 THEN {o} END)"


@query("c6_naive_contrast", f"{_T}, nc AS (SELECT advertiser, count(*) AS n, {_D('win')} AS a, {_D('payment')} AS b, {_D('click')} AS c, {_D('surplus')} AS d FROM ar GROUP BY 1) SELECT advertiser, CAST(n AS BIGINT) AS n, round(a, 6) AS tau_win, round(b, 6) AS tau_payment, round(c, 6) AS tau_click, round(d, 6) AS tau_surplus FROM nc UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), round(sum(n*a)/sum(n), 6), round(sum(n*b)/sum(n), 6), round(sum(n*c)/sum(n), 6), round(sum(n*d)/sum(n), 6) FROM nc")
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.naive_contrast(c.treatment_table(bids(spark, sf_dir), CPC), ["win", "payment", "click", "surplus"]))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _arms(spark, sf_dir)
    for o in ("win", "payment", "surplus"):
        rows = c.map_back(rows, c.stratified_effect(rows, o)).withColumnRenamed("cate", f"tau_{o}")
    return rows


_MAPPED = f"""{_T}, sm AS (SELECT stratum, {_D('win')} AS tw, {_D('payment')} AS tp, {_D('surplus')} AS ts, count(*) AS n FROM ar GROUP BY 1 HAVING count(*) FILTER (arm = 1) >= 5 AND count(*) FILTER (arm = 0) >= 5), av AS (SELECT sum(n*tw)/sum(n) AS aw, sum(n*tp)/sum(n) AS ap, sum(n*ts)/sum(n) AS s0 FROM sm), ma AS (SELECT ar.taxonomy, ar.adexchange, ar.hour, v, coalesce(tw, aw) AS tau_win, coalesce(tp, ap) AS tau_payment, coalesce(ts, s0) AS tau_surplus FROM ar CROSS JOIN av LEFT JOIN sm ON ar.stratum = sm.stratum)"""


@query("c7_decomposition", f"{_MAPPED} SELECT round(corr(tau_surplus, v*tau_win - tau_payment), 6) AS correlation, round(avg(abs(tau_surplus - (v*tau_win - tau_payment))), 4) AS mae, round(avg(tau_surplus - (v*tau_win - tau_payment)), 4) AS bias FROM ma")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = c.check_decomposition(_mapped(spark, sf_dir), "tau_surplus", "tau_win", "tau_payment")
    return r6(got.withColumns({"mae": F.round("mae", 4), "bias": F.round("bias", 4)}))


@query("c8_mediation", f"{_MAPPED} SELECT taxonomy, round(avg(v*tau_win), 4) AS nie, round(avg(tau_surplus) - avg(v*tau_win), 4) AS nde, CAST(count(*) AS BIGINT) AS n FROM ma GROUP BY 1")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.mediation(_mapped(spark, sf_dir), "taxonomy", total="tau_surplus", tau_win="tau_win"), 4)


@query("c9_effect_summary", f"{_MAPPED} SELECT taxonomy, adexchange, round(avg(tau_surplus), 4) AS mean, round(stddev_samp(tau_surplus), 4) AS std, CAST(count(*) AS BIGINT) AS n FROM ma GROUP BY 1, 2")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.effect_summary(_mapped(spark, sf_dir), "taxonomy", "adexchange", effect="tau_surplus"), 4)


@query("c9_effect_pivot", f"{_MAPPED} SELECT adexchange, " + ", ".join(f"round(avg(CASE WHEN least(hour // 6, 3) = {k} THEN tau_surplus END), 4) AS q{k}" for k in range(4)) + " FROM ma GROUP BY 1")
def c9_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.effect_pivot(_mapped(spark, sf_dir), effect="tau_surplus"), 4)


@query("c10_dr_learner")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.effect_summary(c.dr_learner(_arms(spark, sf_dir), "surplus"), "taxonomy"), 4)


@query("c10_dr_intervals")
def c10i(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the learner's mean effects, by campaign kind, over days as clusters."""
    return r6(c.effect_interval(c.dr_learner(_arms(spark, sf_dir), "surplus"), "taxonomy", cluster="day"), 4)


_PSI = f"""{_T}, sm AS (SELECT stratum, avg(CASE WHEN arm = 1 THEN win END) AS m1, avg(CASE WHEN arm = 0 THEN win END) AS m0, avg(arm) AS e FROM ar GROUP BY 1 HAVING sum(arm) >= 5 AND sum(1 - arm) >= 5),
ps AS (SELECT adexchange, day, m1 - m0 + CASE WHEN arm = 1 THEN (win - m1) / e ELSE -(win - m0) / (1 - e) END AS psi FROM ar JOIN sm USING (stratum)),
cu AS (SELECT adexchange, day, sum(psi) AS s, CAST(count(*) AS DOUBLE) AS c FROM ps GROUP BY 1, 2),
te AS (SELECT adexchange, sum(s) / sum(c) AS t, sum(c) AS n, count(*) AS k FROM cu GROUP BY 1),
se AS (SELECT te.adexchange, t, n, k, sqrt(sum((s - t * c) * (s - t * c)) * k / (k - 1.0)) / n AS se FROM cu JOIN te USING (adexchange) GROUP BY 1, 2, 3, 4)
SELECT adexchange, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS units, round(t, 6) AS effect, round(se, 6) AS se, round(t - 1.959964 * se, 6) AS ci_lo, round(t + 1.959964 * se, 6) AS ci_hi FROM se"""


@query("c10_stratified_intervals", _PSI)
def c10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubly robust effects on wins with strata as nuisances, and their intervals over days as clusters."""
    return r6(c.effect_interval(c.stratified_psi(_arms(spark, sf_dir), "win"), "adexchange", cluster="day"))


@query("c11_back_door")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.back_door(_arms(spark, sf_dir), "surplus", ["slotprice", "hour", "region", "advertiser"]), 4)


@query("c12_refutations")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.refute(_arms(spark, sf_dir), "win", ["slotprice", "hour", "region", "advertiser"]), 4)


_GAP = f", gp AS (SELECT advertiser, hour, CASE WHEN least(p_a*{CPC}, 300.0) >= payprice THEN click*{CPC} - payprice ELSE 0 END - CASE WHEN least(p_b*{CPC}, 300.0) >= payprice THEN click*{CPC} - payprice ELSE 0 END AS gap FROM bids WHERE win = 1 AND payprice > 0)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gavel.plans.bidding_queries import _two_surpluses

    return _two_surpluses(spark, sf_dir).withColumn("gap", F.col("s_a") - F.col("s_b"))


def _clusters(df: DataFrame) -> DataFrame:
    return df.groupBy("advertiser").agg(F.sum("gap").alias("gap"), (F.stddev_pop("gap") * F.sqrt(F.count("*").cast("double"))).alias("se"))


@query("c13_c14_c17_report")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.report(_clusters(_gaps(spark, sf_dir)), "p_a against p_b"), 4)


@query("c13_heterogeneity", f"{_GAP}, cg AS (SELECT advertiser, sum(gap) AS gap, stddev_pop(gap)*sqrt(count(*)) AS se FROM gp GROUP BY 1), fx AS (SELECT sum(gap/(se*se))/sum(1/(se*se)) AS fe, sum(1/(se*se)) AS sw, sum(1/(se*se)/(se*se)) AS sw2, count(*) - 1 AS df FROM cg), q AS (SELECT sum((gap - fe)*(gap - fe)/(se*se)) AS q FROM cg, fx) SELECT round(q, 4) AS q, CAST(df AS DOUBLE) AS df, round(greatest(0, (q - df)/q), 4) AS i2, round(greatest(0, (q - df)/(sw - sw2/sw)), 4) AS tau2, round(fe, 4) AS fixed_effect FROM q, fx")
def c13b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.report(_clusters(_gaps(spark, sf_dir)), "x").select("q", "df", "i2", "tau2", "fixed_effect"), 4)


@query("c15_leave_one_out", f"{_GAP}, cg AS (SELECT advertiser, sum(gap) AS gap FROM gp GROUP BY 1) SELECT advertiser, round(gap, 4) AS gap, round((sum(gap) OVER () - gap) / (count(*) OVER () - 1), 4) AS loo_mean FROM cg")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.leave_one_out(_clusters(_gaps(spark, sf_dir)).select("advertiser", "gap"), "advertiser"), 4)


@query("c16_icc", f"{_GAP}, ce AS (SELECT advertiser, hour, avg(gap) AS y FROM gp GROUP BY 1, 2 HAVING count(*) >= 5), cl AS (SELECT advertiser, CAST(count(*) AS DOUBLE) AS n, avg(y) AS m, var_pop(y)*count(*) AS ss FROM ce GROUP BY 1), t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n*n) AS n2, sum(n*m)/sum(n) AS g, sum(ss) AS sw, sum(n*m*m) AS nm2 FROM cl), s AS (SELECT (nm2 - nn*g*g)/(k - 1) AS msb, sw/(nn - k) AS msw, (nn - n2/nn)/(k - 1) AS n0, k, nn FROM t) SELECT round((msb - msw)/(msb + (n0 - 1)*msw), 6) AS icc, CAST(k AS BIGINT) AS n_clusters, CAST(nn AS BIGINT) AS n_cells FROM s")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(c.icc(_gaps(spark, sf_dir), "advertiser", "hour", "gap", 5))
