"""Queries of values, bids, auction replay, policy value (B) and pacing (G), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators import bidding as b
from gavel.operators import market as m
from gavel.operators.features import add_taxonomy
from gavel.plans.market_queries import _MODEL, km_sql, model
from gavel.plans.twins import hash_sql, uniform_sql
from gavel.registry import query, r6
from gavel.sources.logs import kept
from gavel.tables import BIDS_CTE, bids, scores

#: Values of 10..600 beside prices of 1..1000, so that strategies differ.
CPC = 10_000.0
_SC = ", sc AS (UNPIVOT (SELECT * FROM bids) ON p_a, p_b INTO NAME model VALUE p)"
_WON = f", won AS (SELECT *, p_a * {CPC} AS v FROM bids WHERE win = 1 AND payprice > 0)"


def _won(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.won_only(bids(spark, sf_dir)).withColumn("v", b.value("p_a", CPC))


@query("b1_b3_values", f"{_SC} SELECT model, CAST(count(*) AS BIGINT) AS n, round(avg(p*{CPC}), 6) AS mean, round(stddev_pop(p*{CPC}), 6) AS std, round(quantile_cont(p*{CPC}, 0.25), 6) AS p25, round(quantile_cont(p*{CPC}, 0.5), 6) AS median, round(quantile_cont(p*{CPC}, 0.75), 6) AS p75, round(avg(CAST(p*{CPC} > 100 AS INT)), 6) AS above_market, round(avg(p*{CPC}) / 100, 6) AS overbid_ratio FROM sc GROUP BY 1")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(b.value_summary(scores(bids(spark, sf_dir)).withColumn("v", b.value("p", CPC)), 100.0, "model"))


@query("b1_cpm_value", "SELECT advertiser, round(avg(80000.0 / 1000), 6) AS value, round(sum(80000.0 / 1000 - payprice), 4) AS surplus FROM bids WHERE win = 1 GROUP BY 1")
def b1_cpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = bids(spark, sf_dir).where("win = 1").withColumn("v", b.value_cpm(80_000.0))
    return r6(won.groupBy("advertiser").agg(F.avg("v").alias("value"), F.round(F.sum(F.col("v") - F.col("payprice")), 4).alias("surplus")))


@query("b2_cpa_value", "SELECT advertiser, round(avg(p_a * p_b * 5000.0), 6) AS mean FROM bids GROUP BY 1")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(bids(spark, sf_dir).groupBy("advertiser").agg(F.avg(b.value_cpa("p_a", "p_b", 5000.0)).alias("mean")))


def _best_sql(objective: str, p: str = "p_a") -> str:
    return f"{_MODEL}, vs AS (SELECT DISTINCT adexchange, {p} * {CPC} AS v FROM bids), ob AS (SELECT vs.adexchange, v, price, {objective} AS o FROM vs JOIN mo ON vs.adexchange = mo.adexchange AND price >= 1), be AS (SELECT adexchange, v, price AS bid FROM (SELECT *, row_number() OVER (PARTITION BY adexchange, v ORDER BY round(o, 8) DESC, price) AS place FROM ob) WHERE place = 1)"


@query("b4_b8_optimal_bids", f"{_best_sql('(v - price) * cdf')} SELECT adexchange, round(v, 6) AS v, bid FROM be")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    hulls = b.envelope(model(df, "adexchange"), "adexchange")
    return r6(df.select("adexchange", b.value("p_a", CPC).alias("v")).distinct().join(hulls, "adexchange").select("adexchange", "v", b.best_bid(F.col("v")).alias("bid")))


@query("b10_contextual_bids", f"{_best_sql('v * cdf - spend')} SELECT adexchange, round(v, 6) AS v, bid FROM be")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    hulls = b.envelope(model(df, "adexchange"), "adexchange", second_price=True)
    return r6(df.select("adexchange", b.value("p_a", CPC).alias("v")).distinct().join(hulls, "adexchange").select("adexchange", "v", b.best_bid(F.col("v")).alias("bid")))


@query("b5_linear_bids", f"SELECT bidid, round(least(greatest(p_a*{CPC}*0.8, 1.0), 300.0), 6) AS bid FROM bids")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(bids(spark, sf_dir).select("bidid", b.linear_bid(b.value("p_a", CPC), 0.8).alias("bid")))


@query("b6_percentile_bids", f"{_MODEL}, q AS (SELECT adexchange, min(price) AS pp FROM mo WHERE cdf >= 0.25 GROUP BY 1) SELECT bidid, round(least(pp, p_a*{CPC}), 6) AS bid FROM bids JOIN q USING (adexchange)")
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    q = b.percentile_price(model(df, "adexchange"), 0.25, "adexchange")
    return r6(df.join(q, "adexchange").select("bidid", F.least("percentile_price", b.value("p_a", CPC)).alias("bid")))


@query("b7_dual_regime", f"{_best_sql('(v - price) * cdf')}, x AS (SELECT bids.bidid, bids.p_a*{CPC} AS v, slotprice, be.bid AS opt FROM bids JOIN be ON bids.adexchange = be.adexchange AND bids.p_a*{CPC} = be.v) SELECT bidid, CAST(slotprice > 0 AND slotprice > 0.1*v AS INT) AS regime, round(least(greatest(CASE WHEN slotprice > 0 AND slotprice > 0.1*v THEN least(greatest(slotprice*1.05, 1.0), v) ELSE opt END, 1.0), 300.0), 6) AS bid FROM x")
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).withColumn("v", b.value("p_a", CPC))
    df = df.join(b.envelope(model(df, "adexchange"), "adexchange"), "adexchange")
    bid, regime = b.dual_regime(F.col("v"), F.col("slotprice"), b.best_bid(F.col("v")))
    return r6(df.select("bidid", regime.alias("regime"), bid.alias("bid")))


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kept(bids(spark, sf_dir).select("bidid", "adexchange", "bidprice", "payprice", "slotprice", "win", "click", "p_a", "p_b"), "bids")
    won = b.won_only(df).withColumn("v", b.value("p_a", CPC))
    return b.strategies(won, model(df, "adexchange"), model(df))


_OVERALL = km_sql("season * 0").replace("season * 0,", "0 AS z,").replace("PARTITION BY season * 0 ORDER", "ORDER").replace("SELECT season * 0", "SELECT z")
_STRATEGY = f"""{_WON}{_best_sql('(v - price) * cdf')}{_OVERALL.replace('km', 'ka')}, ga AS (SELECT CAST(i AS DOUBLE) AS price, 1 - coalesce(min(survival), 1.0) AS cdf FROM (SELECT unnest(range(0, 301)) AS i) LEFT JOIN ka ON ka.price <= i GROUP BY 1), b0 AS (SELECT v, price AS bid0 FROM (SELECT vv.v, price, row_number() OVER (PARTITION BY vv.v ORDER BY round((vv.v - price) * cdf, 8) DESC, price) AS place FROM (SELECT DISTINCT v FROM vs) vv, ga WHERE price >= 1) WHERE place = 1),
y AS (SELECT won.*, be.bid AS opt, bid0 FROM won JOIN be ON won.adexchange = be.adexchange AND won.v = be.v JOIN b0 ON won.v = b0.v),
st AS (SELECT *, 'flat' AS strategy, CAST(bidprice AS DOUBLE) AS bid FROM y UNION ALL SELECT *, 'truthful', least(greatest(v, 1.0), 300.0) FROM y UNION ALL SELECT *, 'linear_80', least(greatest(v*0.8, 1.0), 300.0) FROM y UNION ALL SELECT *, 'linear_60', least(greatest(v*0.6, 1.0), 300.0) FROM y UNION ALL SELECT *, 'optimal', bid0 FROM y UNION ALL SELECT *, 'optimal_exchange', opt FROM y UNION ALL SELECT *, 'dual_regime', least(greatest(CASE WHEN slotprice > 0 AND slotprice > 0.1*v THEN least(greatest(slotprice*1.05, 1.0), v) ELSE bid0 END, 1.0), 300.0) FROM y)"""


def metrics_sql(pay: str, keys: str, source: str) -> str:
    won, cost = "CAST(bid >= payprice AS INT)", f"CASE WHEN bid >= payprice THEN {pay} ELSE 0 END"
    return f"""SELECT {keys}, CAST(count(*) AS BIGINT) AS n, CAST(sum({won}) AS BIGINT) AS wins, CAST(sum(click*{won}) AS BIGINT) AS clicks, round(sum({cost}), 4) AS spend, round(sum(CASE WHEN bid >= payprice THEN v - {pay} ELSE 0 END), 4) AS surplus, round(avg(CASE WHEN bid >= payprice THEN (bid - payprice) / payprice END), 4) AS overpayment, round(sum({won}) / CAST(count(*) AS DOUBLE), 4) AS win_rate, round(sum(click*{won}) / CAST(nullif(sum({won}), 0) AS DOUBLE), 4) AS ctr, round(sum({cost}) / nullif(sum({won}), 0), 4) AS cpm, round(sum({cost}) / nullif(sum(click*{won}), 0), 4) AS cpc, round(sum(CASE WHEN bid >= payprice THEN v - {pay} ELSE 0 END) / nullif(sum({won}), 0), 4) AS surplus_per_win, round(sum(click*{won}) * {CPC} / nullif(sum({cost}), 0), 4) AS roi FROM {source} GROUP BY ALL"""


@query("b9_b11_b15_second_price", f"{_STRATEGY} {metrics_sql('payprice', 'strategy', 'st')}")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(b.settlement_metrics(b.settle(_strategies(spark, sf_dir), True), "strategy", cpc=CPC), 4)


@query("flagship", f"{_STRATEGY} {metrics_sql('bid', 'strategy', 'st')}")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price curves by exchange, bids of seven strategies, first-price settlement of logged winners."""
    return r6(b.settlement_metrics(b.settle(_strategies(spark, sf_dir), False), "strategy", cpc=CPC), 4)


@query("b13_auction_types", f"{_WON}, st AS (SELECT *, least(greatest(v, 1.0), 300.0) AS bid FROM won) SELECT 'second' AS auction, * FROM ({metrics_sql('payprice', 'adexchange', 'st')}) UNION ALL SELECT 'first', * FROM ({metrics_sql('bid', 'adexchange', 'st')})")
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _won(spark, sf_dir).withColumn("bid", b.linear_bid("v", 1.0))
    one = lambda second, name: b.settlement_metrics(b.settle(df, second), "adexchange", cpc=CPC).withColumn("auction", F.lit(name))
    return r6(one(True, "second").unionByName(one(False, "first")), 4)


@query("b14_won_only", "SELECT bidid, payprice FROM bids WHERE win = 1 AND payprice > 0")
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.won_only(bids(spark, sf_dir)).select("bidid", "payprice")


_ALPHAS = [0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


@query("b16_b26_alpha_sweep", f"{_WON}, s AS (SELECT *, unnest({_ALPHAS}) AS alpha FROM won), st AS (SELECT *, least(greatest(v*alpha, 1.0), 300.0) AS bid FROM s) SELECT advertiser, CAST(alpha AS DOUBLE) AS alpha, CAST(sum(CAST(bid >= payprice AS INT)) AS BIGINT) AS wins, round(sum(CASE WHEN bid >= payprice THEN v - bid ELSE 0 END), 4) AS surplus FROM st GROUP BY 1, 2")
def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = b.sweep(_won(spark, sf_dir), "alpha", _ALPHAS).withColumn("bid", F.least(F.greatest(F.col("v") * F.col("alpha"), F.lit(1.0)), F.lit(300.0)))
    return r6(b.settle(df, False).groupBy("advertiser", "alpha").agg(F.sum("won").alias("wins"), F.sum("surplus").alias("surplus")), 4)


_MULT = [0.5, 0.8, 1.0, 1.2, 1.5]


@query("b17_b29_multipliers", f"{_WON}, s AS (SELECT *, unnest({_MULT}) AS mult FROM won), g AS (SELECT adexchange, CAST(mult AS DOUBLE) AS mult, sum(CAST(bidprice*mult >= payprice AS INT)) AS wins, sum(CASE WHEN bidprice*mult >= payprice THEN v - payprice ELSE 0 END) AS surplus FROM s GROUP BY 1, 2) SELECT g.adexchange, g.mult, CAST(g.wins AS BIGINT) AS wins, round(g.surplus, 4) AS surplus, CAST(g.wins - o.wins AS BIGINT) AS d_wins, round(g.surplus - o.surplus, 4) + 0.0 AS d_surplus FROM g JOIN g o ON g.adexchange = o.adexchange AND o.mult = 1.0")
def b17(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = b.sweep(_won(spark, sf_dir), "mult", _MULT).withColumn("bid", F.col("bidprice") * F.col("mult"))
    g = b.settle(df, True).groupBy("adexchange", "mult").agg(F.sum("won").alias("wins"), F.sum("surplus").alias("surplus"))
    base = g.where("mult = 1.0").select("adexchange", F.col("wins").alias("w0"), F.col("surplus").alias("s0"))
    return r6(g.join(base, "adexchange").select("adexchange", "mult", "wins", "surplus", (F.col("wins") - F.col("w0")).alias("d_wins"), (F.col("surplus") - F.col("s0")).alias("d_surplus")), 4)


@query("b18_policy_value", f"{_MODEL}{_SC}, x AS (SELECT sc.*, least(greatest(floor(p*{CPC}), 1.0), 300.0) AS bid FROM sc), y AS (SELECT x.*, a.cdf AS f1, a.spend AS s1, c.cdf AS f0, c.spend AS s0 FROM x JOIN mo a ON x.adexchange = a.adexchange AND x.bid = a.price JOIN mo c ON x.adexchange = c.adexchange AND x.bidprice = c.price), z AS (SELECT *, CAST(win = 0 AND bid > bidprice AS INT) AS ext, CASE WHEN win = 0 AND bid > bidprice THEN p*{CPC}*(f1 - f0) - (s1 - s0) WHEN win = 1 AND payprice <= bid THEN click*{CPC} - payprice ELSE 0 END AS s FROM y) SELECT model, round(sum(s), 4) AS total, round(sum(CASE WHEN ext = 0 THEN s ELSE 0 END), 4) AS v_exact, round(sum(CASE WHEN ext = 1 THEN s ELSE 0 END), 4) AS v_model, CAST(sum(ext) AS BIGINT) AS n_modelled, CAST(sum(CAST(win = 1 AND payprice <= bid AS INT)) AS BIGINT) AS n_rewon, CAST(count(*) AS BIGINT) AS n, round(abs(sum(CASE WHEN ext = 1 THEN s ELSE 0 END)) / (abs(sum(CASE WHEN ext = 0 THEN s ELSE 0 END)) + abs(sum(CASE WHEN ext = 1 THEN s ELSE 0 END))), 4) AS share_modelled, round(sum(ext) / CAST(count(*) AS DOUBLE), 4) AS rows_modelled FROM z GROUP BY 1")
def b18(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    arrays = m.as_arrays(model(df, "adexchange"), "adexchange")
    rows = m.with_market(scores(df), arrays, "adexchange").withColumn("bid", F.least(F.greatest(F.floor(F.col("p") * CPC).cast("double"), F.lit(1.0)), F.lit(300.0)))
    return r6(b.policy_summary(b.policy_value(rows, cpc=CPC), "model"), 4)


@query("b19_recover_log", f"SELECT advertiser, round(sum(CASE WHEN win = 1 THEN click*{CPC} - payprice ELSE 0 END), 4) AS logged, round(sum(CASE WHEN win = 1 AND payprice <= bidprice THEN click*{CPC} - payprice ELSE 0 END), 4) AS replayed, CAST(count(*) FILTER (win = 1 AND payprice > bidprice) AS BIGINT) AS anomalies FROM bids GROUP BY 1")
def b19(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).withColumns({"p": F.col("p_a"), "bid": F.col("bidprice").cast("double"), "cdf_grid": F.array(F.lit(0.0), F.lit(1.0)), "spend_grid": F.array(F.lit(0.0), F.lit(0.0))})
    got = b.policy_value(df, cpc=CPC)
    worth = F.when(F.col("win") == 1, F.col("click") * CPC - F.col("payprice")).otherwise(0.0)
    return r6(got.groupBy("advertiser").agg(F.sum(worth).alias("logged"), F.sum("s").alias("replayed"), F.count_if((F.col("win") == 1) & (F.col("payprice") > F.col("bidprice"))).alias("anomalies")), 4)


@query("b20_realised_surplus", f"{_WON}, x AS (SELECT *, least(v, 300.0) AS bid FROM won) SELECT round(sum(CASE WHEN bid >= payprice THEN click*{CPC} - payprice ELSE 0 END), 4) AS realised_second, round(sum(CASE WHEN bid >= payprice THEN v - payprice ELSE 0 END), 4) AS model_second, round(sum(CASE WHEN bid >= payprice THEN click*{CPC} - bid ELSE 0 END), 4) AS realised_first, round(sum(CASE WHEN bid >= payprice THEN v - bid ELSE 0 END), 4) AS model_first FROM x")
def b20(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _won(spark, sf_dir).withColumn("bid", F.least("v", F.lit(300.0)))
    real = F.sum(F.when(F.col("won") == 1, F.col("click") * CPC - F.col("payment")).otherwise(0.0))
    one = lambda second, n: b.settle(df, second).agg(real.alias(f"realised_{n}"), F.sum("surplus").alias(f"model_{n}"))
    return r6(one(True, "second").crossJoin(one(False, "first")), 4)


@query("b21_gap_decomposition", f"{_SC}, cal AS (SELECT model, sum(click) / sum(p) AS f FROM sc WHERE win = 1 GROUP BY 1), r AS (SELECT sc.model, 'raw' AS variant, click, payprice, least(p*{CPC}, 300.0) AS bid FROM sc WHERE win = 1 UNION ALL SELECT sc.model, 'recal', click, payprice, least(p*f*{CPC}, 300.0) FROM sc JOIN cal USING (model) WHERE win = 1), s AS (SELECT model, variant, sum(CASE WHEN bid >= payprice THEN click*{CPC} - payprice ELSE 0 END) AS surplus FROM r GROUP BY 1, 2) SELECT round(sum(CASE WHEN model = 'p_a' AND variant = 'recal' THEN surplus WHEN model = 'p_a' THEN -surplus ELSE 0 END), 4) AS calibration_a, round(sum(CASE WHEN model = 'p_b' AND variant = 'recal' THEN surplus WHEN model = 'p_b' THEN -surplus ELSE 0 END), 4) AS calibration_b, round(sum(CASE WHEN variant = 'raw' THEN 0 WHEN model = 'p_a' THEN surplus ELSE -surplus END), 4) AS ranking FROM s")
def b21(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = scores(bids(spark, sf_dir)).where("win = 1")
    cal = won.groupBy("model").agg((F.sum("click") / F.sum("p")).alias("f"))
    rows = won.join(F.broadcast(cal), "model").withColumn("_v", F.explode(F.array(F.struct(F.lit("raw").alias("variant"), F.col("p").alias("q")), F.struct(F.lit("recal").alias("variant"), (F.col("p") * F.col("f")).alias("q"))))).select("*", "_v.*")
    rows = rows.withColumn("s", F.when(F.least(F.col("q") * CPC, F.lit(300.0)) >= F.col("payprice"), F.col("click") * CPC - F.col("payprice")).otherwise(0.0))
    g = rows.groupBy("model", "variant").agg(F.sum("s").alias("surplus")).groupBy().pivot("model", ["p_a", "p_b"]).agg(F.sum(F.when(F.col("variant") == "recal", F.col("surplus"))).alias("recal"), F.sum(F.when(F.col("variant") == "raw", F.col("surplus"))).alias("raw"))
    return r6(g.select((F.col("p_a_recal") - F.col("p_a_raw")).alias("calibration_a"), (F.col("p_b_recal") - F.col("p_b_raw")).alias("calibration_b"), (F.col("p_a_recal") - F.col("p_b_recal")).alias("ranking")), 4)


def _two_surpluses(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = lambda p: F.when(F.least(F.col(p) * CPC, F.lit(300.0)) >= F.col("payprice"), F.col("click") * CPC - F.col("payprice")).otherwise(0.0)
    return b.won_only(bids(spark, sf_dir)).withColumns({"s_a": real("p_a"), "s_b": real("p_b")})


@query("b22_paired_bootstrap")
def b22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(b.paired_bootstrap(_two_surpluses(spark, sf_dir), "s_a", "s_b", 500), 4)


@query("b22_replicate_sums")
def b22r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bootstrap again with a weight of every row in every replicate: the check of b22's normal limit."""
    return r6(b.replicate_interval(b.replicate_sums(_two_surpluses(spark, sf_dir), "s_a", "s_b", 500)), 4)


def _real(p: str) -> str:
    return f"CASE WHEN least({p} * {CPC}, 300.0) >= payprice THEN click * {CPC} - payprice ELSE 0 END"


_CLUSTERS = f""", cl AS (SELECT advertiser, sum({_real('p_a')} - {_real('p_b')}) AS d FROM bids WHERE win = 1 AND payprice > 0 GROUP BY 1),
kc AS (SELECT rep, advertiser, d, rep * 1048576 + advertiser AS unit FROM cl, range(1000) r(rep)){hash_sql('hc', 'kc', 'unit', 7)},
gc AS (SELECT rep, sum(CAST(d AS DOUBLE) * ({' + '.join(f'CAST({uniform_sql()} >= {e!r} AS INT)' for e in b.POISSON_EDGES)})) AS gap FROM kc JOIN hc USING (unit) GROUP BY 1)
SELECT round(quantile_cont(gap, 0.025), 4) AS ci_lo, round(quantile_cont(gap, 0.975), 4) AS ci_hi, round(avg(CAST(gap > 0 AS INT)), 4) AS p_positive, (SELECT round(sum(d), 4) FROM cl) AS gap, (SELECT count(*) FROM cl) AS n_clusters FROM gc"""


@query("b23_cluster_bootstrap", _CLUSTERS)
def b23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(b.cluster_bootstrap(_two_surpluses(spark, sf_dir), "advertiser", "s_a", "s_b", 1000), 4)


@query("b24_win_decomposition", f"{_WON}, x AS (SELECT *, bidprice AS bid FROM won) SELECT advertiser, round(avg(bid), 4) AS mean_bid, CAST(sum(CAST(bid >= payprice AS INT)) AS BIGINT) AS wins, round(sum(CASE WHEN bid >= payprice THEN v - payprice ELSE 0 END), 4) AS surplus, CAST(sum(CAST(bid >= payprice AND v < payprice AS INT)) AS BIGINT) AS bad_wins, round(sum(CAST(bid >= payprice AND v < payprice AS INT)) / CAST(sum(CAST(bid >= payprice AS INT)) AS DOUBLE), 4) AS bad_share FROM x GROUP BY 1")
def b24(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = b.settle(_won(spark, sf_dir).withColumn("bid", F.col("bidprice").cast("double")), True)
    return r6(b.decompose(df, "advertiser"), 4)


@query("b25_regret", f"{_WON}, s AS (SELECT advertiser, sum(greatest(v - payprice, 0)) AS o, sum(CASE WHEN least(p_b*{CPC}, 300.0) >= payprice THEN v - payprice ELSE 0 END) AS bi, sum(CASE WHEN least(p_b*1.2*{CPC}, 300.0) >= payprice THEN v - payprice ELSE 0 END) AS de FROM won GROUP BY 1) SELECT advertiser, round((o - bi) / o, 4) AS regret_biased, round((o - de) / o, 4) AS regret_debiased, round(100 * ((o - bi) / o - (o - de) / o), 4) AS edge FROM s")
def b25(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _won(spark, sf_dir)
    gain = F.col("v") - F.col("payprice")
    got = lambda p: F.when(F.least(p * CPC, F.lit(300.0)) >= F.col("payprice"), gain).otherwise(0.0)
    rows = df.select("advertiser", F.explode(F.array(F.struct(F.lit("oracle").alias("model"), F.greatest(gain, F.lit(0.0)).alias("surplus")), F.struct(F.lit("biased").alias("model"), got(F.col("p_b")).alias("surplus")), F.struct(F.lit("debiased").alias("model"), got(F.col("p_b") * 1.2).alias("surplus")))).alias("x")).select("advertiser", "x.*")
    return r6(b.regret(rows.groupBy("advertiser", "model").agg(F.sum("surplus").alias("surplus")), "advertiser", "oracle", "biased", "debiased"), 4)


@query("b27_calibration_stress", f"{_WON}, s AS (SELECT *, unnest([0.5, 1.0, 1.5, 2.0]) AS factor FROM won) SELECT CAST(factor AS DOUBLE) AS factor, adexchange, round(sum(CASE WHEN least(v*factor, 300.0) >= payprice THEN v - payprice ELSE 0 END), 4) AS surplus, round(sum(CASE WHEN least(v*factor, 300.0) >= payprice THEN v - payprice ELSE 0 END) - sum(greatest(CASE WHEN payprice <= 300 THEN v - payprice ELSE 0 END, 0)), 4) + 0.0 AS loss FROM s GROUP BY 1, 2")
def b27(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = b.sweep(_won(spark, sf_dir), "factor", [0.5, 1.0, 1.5, 2.0]).withColumn("bid", F.least(F.col("v") * F.col("factor"), F.lit(300.0)))
    best = F.greatest(F.when(F.col("payprice") <= 300, F.col("v") - F.col("payprice")).otherwise(0.0), F.lit(0.0))
    return r6(b.settle(df, True).groupBy("factor", "adexchange").agg(F.sum("surplus").alias("surplus"), (F.sum("surplus") - F.sum(best)).alias("loss")), 4)


@query("b30_budget_scan", f"{_WON}, s AS (SELECT *, unnest([0.6, 0.8, 1.0]) AS shade FROM won), t AS (SELECT CAST(shade AS DOUBLE) AS shade, least(v*shade, 300.0) AS bid, v, payprice, bidid FROM s), h AS (SELECT shade, bid, v, sum(bid) OVER (PARTITION BY shade ORDER BY bidid) AS run FROM t WHERE bid >= payprice) SELECT shade, CAST(budget AS DOUBLE) AS budget, CAST(count(*) AS BIGINT) AS wins, round(sum(v - bid), 4) AS surplus, round(sum(v) / sum(bid), 4) AS roi FROM (SELECT *, unnest([5000.0, 50000.0]) AS budget FROM h) WHERE run <= budget GROUP BY 1, 2")
def b30(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = b.sweep(_won(spark, sf_dir), "shade", [0.6, 0.8, 1.0]).withColumn("bid", F.least(F.col("v") * F.col("shade"), F.lit(300.0))).where("bid >= payprice")
    # Blocks of ids first, so that the running sum of one shade is not one task's.
    df = df.withColumn("block", F.floor(F.col("bidid") / 1_000_000))
    sums = df.groupBy("shade", "block").agg(F.sum("bid").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("shade").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    run = df.withColumn("within", F.sum("bid").over(Window.partitionBy("shade", "block").orderBy("bidid"))).join(sums.select("shade", "block", "before"), ["shade", "block"])
    got = b.sweep(run, "budget", [5000.0, 50000.0]).where(F.col("before") + F.col("within") <= F.col("budget"))
    return r6(got.groupBy("shade", "budget").agg(F.count("*").alias("wins"), F.sum(F.col("v") - F.col("bid")).alias("surplus"), (F.sum("v") / F.sum("bid")).alias("roi")), 4)


@query("b32_shading_tiers", ", g AS (SELECT hour, adexchange, quantile_cont(payprice, 0.5) AS med, stddev_pop(payprice) / avg(payprice) AS cv FROM bids WHERE win = 1 GROUP BY 1, 2) SELECT hour, adexchange, CASE WHEN med < 50 THEN 0.65 WHEN med < 100 THEN 0.75 WHEN med < 150 THEN 0.85 ELSE 0.95 END AS tier, round(least(greatest(1 - 0.5*cv, 0.5), 0.95), 6) AS by_variation FROM g")
def b32(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = m.price_stats(bids(spark, sf_dir), "hour", "adexchange")
    tier = F.when(F.col("median") < 50, 0.65).when(F.col("median") < 100, 0.75).when(F.col("median") < 150, 0.85).otherwise(0.95)
    return r6(s.select("hour", "adexchange", tier.alias("tier"), F.least(F.greatest(1 - 0.5 * F.col("std") / F.col("mean"), F.lit(0.5)), F.lit(0.95)).alias("by_variation")))


@query("b33_integrated_bids", ", t AS (SELECT *, CASE WHEN advertiser IN (2821, 3358, 2259) THEN 'retargeting' ELSE 'other' END AS taxonomy FROM bids)" + f", sp AS (SELECT advertiser, sum(payprice) AS spent FROM bids GROUP BY 1), x AS (SELECT bidid, p_a*{CPC} AS v, slotprice, greatest(1000000 - spent, 0) AS rest, CASE WHEN taxonomy = 'retargeting' THEN 0.9 ELSE 0.8 END AS shade FROM t JOIN sp USING (advertiser)) SELECT bidid, round(CASE WHEN greatest(v*shade*0.95, slotprice) > rest THEN 0 ELSE greatest(v*shade*0.95, slotprice) END, 6) AS bid FROM x")
def b33(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = add_taxonomy(bids(spark, sf_dir).withColumn("v", b.value("p_a", CPC)))
    spent = df.groupBy("advertiser").agg(F.greatest(1_000_000 - F.sum("payprice"), F.lit(0)).alias("rest"))
    bid = F.greatest(F.col("v") * F.when(F.col("taxonomy") == "retargeting", 0.9).otherwise(0.8) * 0.95, F.col("slotprice").cast("double"))
    return r6(df.join(spent, "advertiser").select("bidid", F.when(bid > F.col("rest"), 0.0).otherwise(bid).alias("bid")))


@query("b34_overbid_cost", f"{_SC}, g AS (SELECT model, avg(click) AS ctr, abs(avg(p) - avg(click)) / avg(click) AS ieb, count(*) AS n FROM sc WHERE win = 1 GROUP BY 1), c AS (SELECT model, ctr * ieb * {CPC} * n AS cost FROM g) SELECT model, round(cost, 4) AS cost, round(cost / min(cost) OVER (), 4) AS ratio FROM c")
def b34(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    g = scores(bids(spark, sf_dir)).where("win = 1").groupBy("model").agg(F.avg("click").alias("ctr"), (F.abs(F.avg("p") - F.avg("click")) / F.avg("click")).alias("ieb"), F.count("*").alias("n"))
    cost = g.select("model", (F.col("ctr") * F.col("ieb") * CPC * F.col("n")).alias("cost"))
    return r6(cost.withColumn("ratio", F.col("cost") / F.min("cost").over(Window.partitionBy())), 4)


# --- pacing --------------------------------------------------------------------

_HOURS = ", wt0 AS (SELECT i AS hour, coalesce(avg(win), 0.2) * greatest(count(bidid), 1) AS raw FROM (SELECT unnest(range(0, 24)) AS i) LEFT JOIN bids ON bids.hour = i GROUP BY 1), wt AS (SELECT CAST(hour AS INT) AS hour, 24 * raw / sum(raw) OVER () AS weight FROM wt0)"
BUDGET = 2_000.0


@query("g1_hourly_weights", f"{_HOURS} SELECT hour, round(weight, 6) AS weight FROM wt")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(b.hourly_weights(bids(spark, sf_dir)))


@query("g2_ideal_spend", f"{_HOURS} SELECT hour, round(weight, 6) AS weight, round({BUDGET} * sum(weight) OVER (ORDER BY hour) / sum(weight) OVER (), 6) AS ideal FROM wt")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(b.ideal_spend(b.hourly_weights(bids(spark, sf_dir)), BUDGET))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign months stand for days, so that hours hold several bids at every scale."""
    return bids(spark, sf_dir).withColumn("day", F.floor(F.col("day") / 100).cast("long"))


_PID = f"""{_HOURS}, ideal AS (SELECT hour, {BUDGET} * sum(weight) OVER (ORDER BY hour) / sum(weight) OVER () AS ideal FROM wt), sp AS (SELECT advertiser, CAST(floor(day / 100) AS BIGINT) AS day, hour, sum(payprice) AS spend FROM bids GROUP BY 1, 2, 3), dd2 AS (SELECT DISTINCT advertiser, day FROM sp), f AS (SELECT dd2.advertiser, dd2.day, ideal.hour, ideal, CAST(coalesce(spend, 0) AS DOUBLE) AS x FROM dd2 CROSS JOIN ideal LEFT JOIN sp ON sp.advertiser = dd2.advertiser AND sp.day = dd2.day AND sp.hour = ideal.hour)"""


@query("g3_g4_pid_replay", BIDS_CTE.replace("WITH ", "WITH RECURSIVE ", 1) + _PID + """, r AS (SELECT advertiser, day, -1 AS hour, CAST(0 AS DOUBLE) AS spent, CAST(0 AS DOUBLE) AS integ, CAST(0 AS DOUBLE) AS prev, CAST(0 AS DOUBLE) AS multiplier, CAST(0 AS DOUBLE) AS ideal, CAST(0 AS DOUBLE) AS spend FROM dd2
UNION ALL SELECT r.advertiser, r.day, r.hour + 1, r.spent + f.x * least(greatest(1 + (0.3*(f.ideal - r.spent) + 0.05*(r.integ + f.ideal - r.spent) + 0.1*(f.ideal - r.spent - r.prev)) / 200.0, 0.3), 2.0), r.integ + f.ideal - r.spent, f.ideal - r.spent, least(greatest(1 + (0.3*(f.ideal - r.spent) + 0.05*(r.integ + f.ideal - r.spent) + 0.1*(f.ideal - r.spent - r.prev)) / 200.0, 0.3), 2.0), f.ideal, f.x * least(greatest(1 + (0.3*(f.ideal - r.spent) + 0.05*(r.integ + f.ideal - r.spent) + 0.1*(f.ideal - r.spent - r.prev)) / 200.0, 0.3), 2.0) FROM r JOIN f ON f.advertiser = r.advertiser AND f.day = r.day AND f.hour = r.hour + 1)
SELECT advertiser, day, CAST(hour AS INT) AS hour, round(spent, 4) AS spent, round(ideal, 4) AS ideal, round(multiplier, 4) AS multiplier, round(spend, 4) AS spend FROM r WHERE hour >= 0""", bids=False)
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _days(spark, sf_dir)
    spend = df.groupBy("advertiser", "day", "hour").agg(F.sum("payprice").alias("spend"))
    ideal = b.ideal_spend(b.hourly_weights(df), BUDGET)
    return r6(b.pid_replay(spend, ideal, BUDGET).select("advertiser", "day", "hour", "spent", "ideal", "multiplier", "spend"), 4)


_THROTTLE = f"""{hash_sql('hx', 'bids', 'bidid', 5)}, dm AS (SELECT bidid, advertiser, CAST(floor(day / 100) AS BIGINT) AS day, hour, payprice FROM bids),
hs AS (SELECT advertiser, day, hour, sum(payprice) AS s FROM dm GROUP BY 1, 2, 3),
sb AS (SELECT advertiser, day, hour, coalesce(sum(s) OVER (PARTITION BY advertiser, day ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM hs),
rt AS (SELECT *, ({BUDGET} - b) / CAST(greatest(24 - hour, 1) AS DOUBLE) AS ideal, CASE WHEN hour > 0 THEN b / CAST(hour AS DOUBLE) ELSE ({BUDGET} - b) / 24.0 END AS rate FROM sb)
SELECT advertiser, hour, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN rate > 1.2*ideal THEN CAST({uniform_sql()} > 1 - ideal / rate AS INT) ELSE 1 END) AS BIGINT) AS joined FROM dm JOIN rt USING (advertiser, day, hour) JOIN hx USING (bidid) GROUP BY 1, 2"""


@query("g5_throttle", _THROTTLE)
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = _days(spark, sf_dir)
    hours = df.groupBy("advertiser", "day", "hour").agg(F.sum("payprice").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("advertiser", "day").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.join(hours.withColumn("spent_before", before).drop("s"), ["advertiser", "day", "hour"])
    return r6(b.throttle(rows, BUDGET).groupBy("advertiser", "hour").agg(F.count("*").alias("n"), F.sum("joins").alias("joined")))


def _paced_sql(kp: float = 0.3, ki: float = 0.05, kd: float = 0.1) -> str:
    """The replay hour by hour: a state of each campaign day before each hour."""
    sql = f""", dm AS (SELECT advertiser, CAST(floor(day / 100) AS BIGINT) AS day, hour, bidid, p_a * {CPC} AS v, payprice, click FROM bids WHERE win = 1 AND payprice > 0),
il AS (SELECT i AS hour, {BUDGET} * sum(raw) OVER (ORDER BY i) / sum(raw) OVER () AS ideal FROM (SELECT i, CASE WHEN count(bidid) > 0 THEN CAST(count(bidid) AS DOUBLE) ELSE 0.2 END AS raw FROM range(24) r(i) LEFT JOIN dm ON dm.hour = i GROUP BY 1)),
st0 AS (SELECT DISTINCT advertiser, day, CAST(0 AS DOUBLE) AS spent, CAST(0 AS DOUBLE) AS integral, CAST(0 AS DOUBLE) AS prev, CAST(0 AS BIGINT) AS wins, CAST(0 AS BIGINT) AS clicks FROM dm)"""
    for h in range(24):
        sql += f""", e{h} AS (SELECT st{h}.*, ideal - spent AS error FROM st{h}, il WHERE hour = {h}),
m{h} AS MATERIALIZED (SELECT advertiser, day, spent, wins, clicks, integral + error AS integral, error AS prev, least(greatest(1 + ({kp} * error + {ki} * (integral + error) + {kd} * (error - prev)) / {max(0.1 * BUDGET, 1.0)}, 0.3), 2.0) AS m FROM e{h}),
x{h} AS (SELECT advertiser, day, click, spent, least(v * m, 300.0) AS bid, sum(least(v * m, 300.0)) OVER (PARTITION BY advertiser, day ORDER BY bidid ROWS UNBOUNDED PRECEDING) AS cum FROM dm JOIN m{h} USING (advertiser, day) WHERE hour = {h} AND least(v * m, 300.0) >= payprice),
t{h} AS (SELECT advertiser, day, sum(bid) AS s, count(*) AS n, sum(click) AS c FROM x{h} WHERE spent + cum <= {BUDGET} GROUP BY 1, 2),
st{h + 1} AS MATERIALIZED (SELECT advertiser, day, spent + coalesce(s, 0) AS spent, integral, prev, wins + coalesce(n, 0) AS wins, clicks + coalesce(c, 0) AS clicks FROM m{h} LEFT JOIN t{h} USING (advertiser, day))"""
    return f"{sql} SELECT advertiser, day, round(spent, 4) AS spent, CAST(wins AS BIGINT) AS wins, CAST(clicks AS BIGINT) AS clicks FROM st24"


@query("g6_paced_auction", _paced_sql())
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = b.won_only(_days(spark, sf_dir)).withColumn("v", b.value("p_a", CPC))
    ideal = {r["hour"]: r["ideal"] for r in b.ideal_spend(b.hourly_weights(df), BUDGET).collect()}  # 24 rows
    return r6(b.paced_auction(df, ideal, BUDGET), 4)


_SHARES = ", sh AS (SELECT 'uniform' AS weighting, hour, 1 / 24.0 AS share FROM won GROUP BY 2 UNION ALL SELECT 'volume_share', hour, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) FROM won GROUP BY 2 UNION ALL SELECT 'spend_share', hour, sum(payprice) / CAST(sum(sum(payprice)) OVER () AS DOUBLE) FROM won GROUP BY 2)"


@query("g7_g8_hour_greedy", f"{_WON}{_SHARES}, x AS (SELECT hour, v - payprice AS profit, payprice, click, sum(payprice) OVER (PARTITION BY hour ORDER BY floor((v - payprice) / 5) DESC, v - payprice DESC, bidid ROWS UNBOUNDED PRECEDING) AS cum FROM won WHERE least(v, 300.0) >= payprice), g AS (SELECT weighting, CAST(budget AS DOUBLE) AS budget, count(*) AS wins, sum(payprice) AS spend, sum(profit) AS surplus, sum(click) AS clicks FROM x JOIN (SELECT *, unnest([2000.0, 20000.0, 100000.0]) AS budget FROM sh) c ON x.hour = c.hour WHERE cum <= budget * share GROUP BY 1, 2) SELECT weighting, budget, CAST(wins AS BIGINT) AS wins, CAST(spend AS BIGINT) AS spend, round(surplus, 4) AS surplus, CAST(clicks AS BIGINT) AS clicks, round(spend / budget, 4) AS utilisation, CAST(clicks - lag(clicks) OVER (PARTITION BY weighting ORDER BY budget) AS BIGINT) AS marginal FROM g")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = _won(spark, sf_dir)
    hours = df.groupBy("hour").agg(F.count("*").alias("n"), F.sum("payprice").alias("s"))  # 24 rows
    total = Window.partitionBy()
    kinds = F.array(*[F.struct(F.lit(k).alias("weighting"), v.alias("share")) for k, v in (("uniform", F.lit(1 / 24.0)), ("volume_share", F.col("n") / F.sum("n").over(total)), ("spend_share", F.col("s") / F.sum("s").over(total)))])
    shares = hours.select("hour", kinds.alias("k")).select("hour", F.explode("k").alias("x")).select("hour", "x.*")
    return r6(b.marginal(b.hour_greedy(df, shares, [2000.0, 20000.0, 100000.0]), "budget", "clicks", "weighting"), 4)


@query("g9_conversion_weights", "SELECT i AS hour, round(coalesce(24.0 * n / sum(n) OVER (), 0), 6) AS weight, CASE WHEN i BETWEEN 9 AND 18 THEN 1.5 WHEN i BETWEEN 19 AND 22 THEN 1.2 ELSE 0.5 END AS default_weight FROM (SELECT CAST(unnest(range(0, 24)) AS INT) AS i) LEFT JOIN (SELECT hour, sum(conversion) AS n FROM bids GROUP BY 1) h ON h.hour = i")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    spine = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    g = spine.join(bids(spark, sf_dir).groupBy("hour").agg(F.sum("conversion").alias("n")), "hour", "left")
    usual = F.when(F.col("hour").between(9, 18), 1.5).when(F.col("hour").between(19, 22), 1.2).otherwise(0.5)
    return r6(g.select("hour", F.coalesce(24.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), F.lit(0.0)).alias("weight"), usual.alias("default_weight")))


