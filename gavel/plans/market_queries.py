"""Queries of win rates and market prices (W), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators import market as m
from gavel.registry import query, r6
from gavel.sources.logs import kept
from gavel.tables import bids

_Z = 1.959964


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, z = f"({k} / CAST({n} AS DOUBLE))", _Z
    mid = f"(({p} + {z * z / 2} / {n}) / (1 + {z * z} / {n}))"
    half = f"({z} / (1 + {z * z} / {n}) * sqrt({p} * (1 - {p}) / {n} + {z * z / 4} / (CAST({n} AS DOUBLE) * {n})))"
    return f"round(greatest({mid} - {half}, 0.0), 6)", f"round(least({mid} + {half}, 1.0), 6)"


def km_sql(key: str = "adexchange", where: str = "1 = 1", name: str = "km") -> str:
    """CTEs ending in <name>(key, price, at_risk, events, survival, v)."""
    return f""", {name}0 AS (SELECT {key}, greatest(CAST(CASE WHEN win = 1 THEN payprice ELSE bidprice END AS DOUBLE), 0.01) AS t, count(*) AS n, sum(win) AS d FROM bids WHERE {where} GROUP BY 1, 2),
    {name}1 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {key} ORDER BY t DESC) AS DOUBLE) AS risk FROM {name}0),
    {name} AS (SELECT {key}, t AS price, risk AS at_risk, d AS events, CASE WHEN max(CAST(d >= risk AS INT)) OVER o = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < risk THEN ln(1 - d / risk) ELSE 0 END) OVER o) END AS survival, sum(CASE WHEN d < risk THEN d / (risk * (risk - d)) ELSE 0 END) OVER o AS v FROM {name}1 WINDOW o AS (PARTITION BY {key} ORDER BY t))"""


def grid_sql(key: str = "adexchange", km: str = "km", name: str = "gr") -> str:
    """CTE <name>(key, price, survival, cdf) on whole prices 0..300."""
    return f""", {name} AS (SELECT s.{key}, CAST(i AS DOUBLE) AS price, coalesce(min(survival), 1.0) AS survival, 1 - coalesce(min(survival), 1.0) AS cdf FROM (SELECT DISTINCT {key} FROM {km}) s CROSS JOIN (SELECT unnest(range(0, 301)) AS i) LEFT JOIN {km} ON {km}.{key} = s.{key} AND {km}.price <= i GROUP BY 1, 2)"""


_LO, _HI = wilson_sql("sum(win)", "count(*)")


@query("w1_w2_win_rate_curve", f"SELECT CAST(bidprice AS DOUBLE) AS price, CAST(count(*) AS BIGINT) AS n, round(avg(win), 6) AS win_rate, {_LO} AS ci_lo, {_HI} AS ci_hi FROM bids GROUP BY 1 HAVING count(*) >= 100")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.win_rate_curve(bids(spark, sf_dir)))


@query("w3_equal_width", ", q AS (SELECT quantile_cont(bidprice, 0.99) AS top FROM bids) SELECT adexchange, CAST(least(floor(bidprice * 20 / top), 19) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(win), 6) AS win_rate FROM bids, q WHERE bidprice <= top GROUP BY 1, 2")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.equal_width_curve(bids(spark, sf_dir), "adexchange"))


_STATS = "CAST(count(*) AS BIGINT) AS n, round(avg(payprice), 6) AS mean, round(stddev_pop(payprice), 6) AS std, round(avg(CAST(abs(payprice - slotprice) < 1 AS INT)), 6) AS floor_binding, " + ", ".join(f"round(quantile_cont(payprice, {q}), 6) AS {x}" for q, x in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95")))


@query("w4_price_stats", f"SELECT {_STATS} FROM bids WHERE win = 1")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.price_stats(bids(spark, sf_dir)))


@query("w5_empirical_cdf", ", e AS (SELECT min(payprice) AS lo, max(payprice) AS hi, count(*) AS n FROM bids WHERE win = 1), g AS (SELECT i, lo + (hi - lo) * i / CAST(199 AS DOUBLE) AS price, n FROM e, (SELECT unnest(range(0, 200)) AS i)) SELECT CAST(i AS INT) AS i, round(price, 6) AS price, round((SELECT count(*) FROM bids WHERE win = 1 AND payprice <= round(g.price, 9)) / CAST(n AS DOUBLE), 6) AS cdf FROM g")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.empirical_cdf(bids(spark, sf_dir)))


@query("w6_w7_win_rate_lookup", ", l AS (SELECT advertiser, CAST(bidprice AS DOUBLE) AS x, avg(win) AS y, count(*) AS n FROM bids GROUP BY 1, 2), s AS (SELECT advertiser FROM l GROUP BY 1 HAVING sum(n) >= 200 AND count(*) >= 2), a AS (SELECT advertiser, x, y, lead(x) OVER o AS x2, lead(y) OVER o AS y2, min(x) OVER (PARTITION BY advertiser) AS x0 FROM l WHERE advertiser IN (SELECT advertiser FROM s) WINDOW o AS (PARTITION BY advertiser ORDER BY x)) SELECT advertiser, CAST(i AS INT) AS price, round(CASE WHEN i <= x OR x2 IS NULL THEN y ELSE y + (y2 - y) * (i - x) / (x2 - x) END, 6) AS win_prob FROM a, (SELECT unnest(range(0, 301)) AS i) WHERE i >= CASE WHEN x = x0 THEN 0 ELSE x END AND i < coalesce(x2, 301)")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.win_rate_lookup(bids(spark, sf_dir), "advertiser"))


@query("w8_durations", "SELECT bidid, greatest(CAST(CASE WHEN win = 1 THEN payprice ELSE bidprice END AS DOUBLE), 0.01) AS t, win AS event FROM bids")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.durations(bids(spark, sf_dir)).select("bidid", "t", "event")


@query("w9_w11_kaplan_meier", f"{km_sql()} SELECT adexchange, price, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events, round(survival, 6) AS survival, round(1 - survival, 6) AS cdf, round(CASE WHEN survival > 0 AND survival < 1 THEN exp(-exp(ln(-ln(survival)) + {_Z} * sqrt(v) / abs(ln(survival)))) ELSE survival END, 6) AS ci_lo, round(CASE WHEN survival > 0 AND survival < 1 THEN exp(-exp(ln(-ln(survival)) - {_Z} * sqrt(v) / abs(ln(survival)))) ELSE survival END, 6) AS ci_hi FROM km")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.kaplan_meier(bids(spark, sf_dir), "adexchange"))


@query("w11_km_regimes", ", bx AS (SELECT *, concat(adexchange, CASE WHEN slotprice > 0 THEN '_floor' ELSE '_open' END) AS regime FROM bids)" + km_sql("regime").replace("FROM bids", "FROM bx") + grid_sql("regime") + " SELECT regime, price, round(survival, 6) AS survival, round(cdf, 6) AS cdf FROM gr")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).withColumn("regime", F.concat("adexchange", F.when(F.col("slotprice") > 0, "_floor").otherwise("_open")))
    return r6(m.on_grid(m.kaplan_meier(df, "regime"), "regime"))


@query("w9_median", f"{km_sql()} SELECT adexchange, min(CASE WHEN survival <= 0.5 THEN price END) AS median FROM km GROUP BY 1")
def w9m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.km_median(m.kaplan_meier(bids(spark, sf_dir), "adexchange"), "adexchange")


@query("w12_w13_parametric")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.parametric_fits(bids(spark, sf_dir)), 4)


_EXPONENTIAL = ", du AS (SELECT greatest(CAST(CASE WHEN win = 1 THEN payprice ELSE bidprice END AS DOUBLE), 0.01) AS t, win AS e FROM bids WHERE NOT (win = 1 AND slotprice > 0 AND payprice = slotprice)), ef AS (SELECT sum(t) / sum(e) AS scale, count(*) AS n, sum(e) AS k FROM du)"


@query("w12_exponential", f"{_EXPONENTIAL} SELECT round(ln(scale), 4) AS a, round(-k * (ln(scale) + 1), 2) AS log_likelihood, round(2 + 2 * k * (ln(scale) + 1), 2) AS aic, round(ln(n) + 2 * k * (ln(scale) + 1), 2) AS bic, 1 AS converged FROM ef")
def w12e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponential's fit, whose closed form is the mean time at risk of an event."""
    got = m.parametric_fits(bids(spark, sf_dir)).where("distribution = 'exponential'")
    return r6(got.select(F.round("a", 4).alias("a"), *[F.round(c, 2).alias(c) for c in ("log_likelihood", "aic", "bic")], "converged"))


@query("w12_exponential_curve", f"{_EXPONENTIAL} SELECT CAST(i AS DOUBLE) AS price, round(1 - exp(-i / scale), 6) AS cdf, round(exp(-i / scale) / scale, 6) AS pdf FROM ef, range(1, 301) r(i)")
def w12c(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = m.parametric_fits(bids(spark, sf_dir)).where("distribution = 'exponential'")
    return r6(m.parametric_curves(fits).drop("distribution"))


@query("w12_curves")
def w12a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution and density of all three fits on the price grid."""
    return r6(m.parametric_curves(m.parametric_fits(bids(spark, sf_dir))))


@query("w14_cdf_comparison", ", one AS (SELECT 1)" + km_sql("season * 0").replace("season * 0,", "0 AS z,").replace("PARTITION BY season * 0 ORDER", "ORDER").replace("SELECT season * 0", "SELECT z") + km_sql("season * 0", "win = 1", "kw").replace("season * 0,", "0 AS z,").replace("PARTITION BY season * 0 ORDER", "ORDER").replace("SELECT season * 0", "SELECT z") + grid_sql("z") + grid_sql("z", "kw", "gw") + " SELECT round(avg(abs(gr.cdf - gw.cdf)), 6) AS mean_abs, round(max(abs(gr.cdf - gw.cdf)), 6) AS ks FROM gr JOIN gw USING (price)")
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.compare_cdfs(bids(spark, sf_dir)))


def model(df: DataFrame, *keys: str) -> DataFrame:
    """W15 of bids. The curve, a row for each price of a segment, is kept: the grid reads it twice, and plans read the grid several times."""
    return m.market_model(m.on_grid(kept(m.kaplan_meier(df, *keys), "curve"), *keys), *keys)


_MODEL = km_sql() + grid_sql() + ", mo0 AS (SELECT *, (cdf - coalesce(lag(cdf) OVER o, cdf)) * (price + coalesce(lag(price) OVER o, price)) / 2 AS mass FROM gr WINDOW o AS (PARTITION BY adexchange ORDER BY price)), mo AS (SELECT adexchange, price, cdf, sum(mass) OVER (PARTITION BY adexchange ORDER BY price) AS spend FROM mo0)"


@query("w15_market_model", f"{_MODEL} SELECT adexchange, price, round(cdf, 6) AS cdf, round(spend, 6) AS spend FROM mo")
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(model(bids(spark, sf_dir), "adexchange").drop("survival"))


@query("w16_model_audit", f"{_MODEL}, c AS (SELECT adexchange, bidprice, count(*) AS n, avg(win) AS r, {_LO} AS lo, {_HI} AS hi FROM bids GROUP BY 1, 2 HAVING count(*) >= 20) SELECT c.adexchange, bidprice, CAST(n AS BIGINT) AS n, round(cdf, 6) AS f, round(r, 6) AS win_rate, lo AS ci_lo, hi AS ci_hi FROM c JOIN mo ON c.adexchange = mo.adexchange AND c.bidprice = mo.price")
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    return r6(m.audit(df, model(df, "adexchange"), "adexchange", 20).drop("inside"))


@query("w17_hourly_f300", f"{km_sql('hour')}{grid_sql('hour')} SELECT gr.hour, round(cdf, 6) AS f300, round(r, 6) AS win_rate FROM gr JOIN (SELECT hour, avg(win) AS r FROM bids GROUP BY 1) h ON h.hour = gr.hour WHERE price = 300")
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    curve = m.on_grid(m.kaplan_meier(df, "hour"), "hour").where("price = 300").select("hour", F.col("cdf").alias("f300"))
    return r6(curve.join(df.groupBy("hour").agg(F.avg("win").alias("win_rate")), "hour"))


@query("w18_segment_prices", f"SELECT concat(hour, '_', adexchange) AS segment, {_STATS} FROM bids WHERE win = 1 GROUP BY 1 HAVING count(*) > 20 UNION ALL SELECT '_default', {_STATS} FROM bids WHERE win = 1")
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    cells = m.price_stats(df, "hour", "adexchange").where("n > 20").withColumn("segment", F.concat("hour", F.lit("_"), "adexchange")).drop("hour", "adexchange")
    return r6(cells.unionByName(m.price_stats(df).withColumn("segment", F.lit("_default"))))


def _logistic_sql(steps: int = 12) -> str:
    """Newton's steps for an intercept and a slope, from 0."""
    sql = ", lc AS (SELECT adexchange, ln(bidprice / CAST(greatest(slotprice, 1) AS DOUBLE)) AS x, CAST(count(*) AS DOUBLE) AS n, avg(win) AS y FROM bids GROUP BY adexchange, bidprice, slotprice), n0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b)"
    for i in range(steps):
        sql += f", s{i} AS (SELECT a, b, sum(n * (y - p)) AS g0, sum(n * (y - p) * x) AS g1, sum(n * p * (1 - p)) AS h0, sum(n * p * (1 - p) * x) AS h1, sum(n * p * (1 - p) * x * x) AS h2 FROM (SELECT lc.*, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM lc, n{i}) GROUP BY 1, 2), n{i + 1} AS MATERIALIZED (SELECT a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM s{i})"
    return f"{sql} SELECT adexchange, round(sum(n / (1 + exp(-(a + b * x)))) / sum(n), 4) AS mean_p, round(sum(n * b * (1 - 1 / (1 + exp(-(a + b * x))))) / sum(n), 4) AS elasticity, round(any_value(b), 4) AS beta, 1 AS converged FROM lc, n{steps} GROUP BY 1"


@query("w19_logistic_elasticity", _logistic_sql())
def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.logistic_win_rate(bids(spark, sf_dir), "adexchange"), 4)


@query("w20_log_normal", "SELECT adexchange, round(avg(ln(payprice)), 6) AS mu, round(stddev_pop(ln(payprice)), 6) AS sigma FROM bids WHERE win = 1 AND payprice > 0 GROUP BY 1")
def w20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.log_normal_mle(bids(spark, sf_dir), "adexchange"))
