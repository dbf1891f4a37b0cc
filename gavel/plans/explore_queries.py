"""Queries of the funnel's exploration (E), tags (U) and windows (Z), with their SQL twins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavel.functions.columns import ratio, ts_seconds
from gavel.operators import explore as e
from gavel.operators import features as f
from gavel.operators.order import quantiles
from gavel.plans.feature_queries import _GROUP, _KIND, _WD
from gavel.plans.twins import hash_sql
from gavel.registry import query, r6
from gavel.tables import bids

_SUMS = "CAST(count(*) AS BIGINT) AS n_bids, CAST(sum(win) AS BIGINT) AS n_wins, CAST(sum(click) AS BIGINT) AS n_clicks, CAST(sum(conversion) AS BIGINT) AS n_conversions"
_RATES = "round(sum(win) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS win_rate, round(sum(click) / CAST(greatest(sum(win), 1) AS DOUBLE), 6) AS ctr, round(sum(conversion) / CAST(greatest(sum(click), 1) AS DOUBLE), 6) AS cvr, round(sum(conversion) / CAST(greatest(sum(win), 1) AS DOUBLE), 6) AS ctcvr"
_BIGN = "CAST(count(*) AS BIGINT) AS n"
_WR = "round(avg(win), 6) AS win_rate"


@query("s6_funnel", f"SELECT 'all' AS part, {_SUMS}, round(avg(bidprice), 6) AS mean_bid, {_RATES} FROM bids UNION ALL SELECT 'season ' || season, {_SUMS}, round(avg(bidprice), 6), {_RATES} FROM bids GROUP BY season UNION ALL (SELECT 'day ' || day, {_SUMS}, round(avg(bidprice), 6), {_RATES} FROM bids GROUP BY day ORDER BY day LIMIT 10)")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    parts = [e.funnel(df.withColumn("part", F.lit("all")), "part"), e.funnel(df.withColumn("part", F.concat(F.lit("season "), "season")), "part"), e.funnel(df, "day").orderBy("day").limit(10).withColumn("part", F.concat(F.lit("day "), "day")).drop("day")]
    return r6(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("e2_campaign_funnel", f"SELECT advertiser, {_SUMS}, round(avg(bidprice), 6) AS mean_bid, {_RATES} FROM bids GROUP BY 1")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(e.funnel(bids(spark, sf_dir), "advertiser"))


@query("e1_e3_win_rates", " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, {_BIGN}, {_WR} FROM {{src}} GROUP BY {c}".replace("{src}", "bids") for c in ("hour", "adexchange", "slotvisibility", "advertiser")) + f" UNION ALL (SELECT 'slot' AS dimension, value, {_BIGN}, {_WR} FROM (SELECT concat(slotwidth, 'x', slotheight) AS value, win FROM bids) GROUP BY 2 ORDER BY n DESC, value LIMIT 10)")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).withColumn("slot", F.concat("slotwidth", F.lit("x"), "slotheight"))
    aggs = {"n": F.count("*"), "win_rate": F.avg("win")}
    tables = e.run_groupings(df, [e.GroupSpec(c, [c], aggs, order=[F.desc("n"), c], head=10 if c == "slot" else None) for c in ("hour", "adexchange", "slotvisibility", "advertiser", "slot")])
    out = None
    for name, t in tables.items():
        t = t.select(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value"), "n", "win_rate")
        out = t if out is None else out.unionByName(t)
    return r6(out)


@query("e3_bid_deciles", ", q AS (SELECT list_sort(list_distinct(quantile_cont(bidprice, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM bids) SELECT CAST(len(list_filter(e[2:len(e)-1], lambda x: bidprice > x)) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(win), 6) AS win_rate FROM bids, q GROUP BY 1")
def e3b(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    edges = f.quantile_edges(df, "bidprice", [i / 10 for i in range(11)])
    return r6(df.groupBy(f.bin_right_closed(F.col("bidprice"), edges).alias("bin")).agg(F.count("*").alias("n"), F.avg("win").alias("win_rate")))


def _pivot_sql(row: str, column: str, values: list) -> str:
    return f"SELECT {row}, " + ", ".join(f"round(avg(CASE WHEN {column} = {v} THEN win END), 6) AS {column}_{v}" for v in values) + f" FROM bids GROUP BY {row}"


_PIVOTS = {"hour_advertiser": ("hour", "advertiser", [1458, 3358, 3386, 3427, 3476]), "region_hour": ("region", "hour", list(range(24))), "format_visibility": ("slotformat", "slotvisibility", [0, 1, 2, 255]), "advertiser_exchange": ("advertiser", "adexchange", [1, 2, 3]), "season_exchange": ("season", "adexchange", [1, 2, 3])}
for _name, (_row, _column, _values) in _PIVOTS.items():
    query(f"e4_pivot_{_name}", _pivot_sql(_row, _column, _values))(lambda spark, sf_dir, a=(_row, _column, _values): r6(e.pivot_rate(bids(spark, sf_dir), *a)))


@query("e5_attribution", "SELECT advertiser, CAST(sum(CASE WHEN conversion = 1 AND click = 1 THEN 1 ELSE 0 END) AS BIGINT) AS click_through, CAST(sum(CASE WHEN conversion = 1 AND click = 0 THEN 1 ELSE 0 END) AS BIGINT) AS view_through FROM bids GROUP BY 1")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.attribution(bids(spark, sf_dir), "advertiser")


def event_logs(df: DataFrame) -> dict[str, DataFrame]:
    """Impressions, clicks and conversions of the bid table with their own times: at once, 12 + id % 7 and 13 + id % 11 seconds later."""
    t = ts_seconds("timestamp")
    shift = {"imp": ("win", t), "clk": ("click", t + 12 + F.col("bidid") % 7), "conv": ("conversion", t + 13 + F.col("bidid") % 11)}
    return {k: df.where(F.col(flag) == 1).select("bidid", at.alias(f"{k}_ts")) for k, (flag, at) in shift.items()}


@query("e6_x1_attribution_windows", ", a AS (SELECT 12 + bidid % 7 AS ic, CASE WHEN conversion = 1 THEN 13 + bidid % 11 END AS iv FROM bids WHERE click = 1), b AS (SELECT ic, iv, iv - ic AS cv FROM a), u AS (SELECT 'imp_click' AS step, ic AS s FROM b UNION ALL SELECT 'imp_conv', iv FROM b UNION ALL SELECT 'click_conv', cv FROM b) SELECT step, CAST(count(s) AS BIGINT) AS n, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.25), 6) AS p25, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.75), 6) AS p75, round(quantile_cont(s, 0.95), 6) AS p95, CAST(max(s) AS DOUBLE) AS most, round(count(s) / CAST(count(*) AS DOUBLE), 6) AS join_rate FROM u GROUP BY 1")
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = event_logs(bids(spark, sf_dir))
    both = logs["clk"].join(logs["imp"], "bidid", "left").join(logs["conv"], "bidid", "left")
    long = both.select((F.col("clk_ts") - F.col("imp_ts")).alias("imp_click"), (F.col("conv_ts") - F.col("imp_ts")).alias("imp_conv"), (F.col("conv_ts") - F.col("clk_ts")).alias("click_conv")).unpivot([], ["imp_click", "imp_conv", "click_conv"], "step", "s")
    q = F.percentile("s", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.95))))
    got = long.groupBy("step").agg(F.count("s").alias("n"), F.avg("s").alias("mean"), q.alias("q"), F.max("s").cast("double").alias("most"), (F.count("s") / F.count("*")).alias("join_rate"))
    return r6(got.select("step", "n", "mean", *[F.col("q")[i].alias(x) for i, x in enumerate(("p25", "p50", "p75", "p95"))], "most", "join_rate"))


@query("e7_least_rows", "SELECT domain, CAST(count(*) AS BIGINT) AS n FROM bids WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) >= 20")
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.least_rows(bids(spark, sf_dir), "domain", 20).groupBy("domain").agg(F.count("*").alias("n"))


def _describe_sql(expr: str, where: str = "1 = 1", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}CAST(count(v) AS BIGINT) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, CAST(min(v) AS DOUBLE) AS least, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, CAST(max(v) AS DOUBLE) AS most FROM (SELECT *, {expr} AS v FROM bids WHERE {where})" + (f" GROUP BY {keys}" if keys else "")


@query("e8_spread", f"SELECT 'spread' AS measure, * FROM ({_describe_sql('bidprice - payprice', 'win = 1')}) UNION ALL SELECT 'ratio', n, mean, std, round(least, 6), p25, p50, p75, round(most, 6) FROM ({_describe_sql('bidprice / CAST(CASE WHEN payprice = 0 THEN 1 ELSE payprice END AS DOUBLE)', 'win = 1')})".replace(", bids", ", bids"))
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = bids(spark, sf_dir).where("win = 1").select((F.col("bidprice") - F.col("payprice")).alias("spread"), (F.col("bidprice") / F.when(F.col("payprice") == 0, 1).otherwise(F.col("payprice")).cast("double")).alias("ratio"))
    return r6(e.describe(won, "spread").withColumn("measure", F.lit("spread")).unionByName(e.describe(won, "ratio").withColumn("measure", F.lit("ratio"))))


@query("e9_flat_bids", ", g AS (SELECT advertiser, avg(bidprice) AS mean_bid, coalesce(stddev_samp(bidprice), 0) AS std_bid, min(bidprice) AS min_bid, max(bidprice) AS max_bid, quantile_cont(bidprice, 0.5) AS median_bid, avg(CASE WHEN win = 1 THEN bidprice - payprice END) AS saving FROM bids GROUP BY 1) SELECT advertiser, round(mean_bid, 6) AS mean_bid, round(std_bid, 6) AS std_bid, min_bid, max_bid, round(median_bid, 6) AS median_bid, round(saving, 6) AS saving, round(std_bid / mean_bid, 6) AS cv, CASE WHEN std_bid / mean_bid < 0.01 THEN 'flat' WHEN std_bid / mean_bid < 0.05 THEN 'near_flat' ELSE 'varied' END AS kind FROM g")
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(e.flat_bids(bids(spark, sf_dir), "advertiser"))


@query("e10_floor_coverage", "SELECT adexchange, round(avg(CAST(bidprice >= slotprice AS INT)), 6) AS coverage, round(avg(slotprice), 6) AS floor_mean, round(quantile_cont(slotprice, 0.5), 6) AS floor_median, round(avg(slotprice / CAST(bidprice AS DOUBLE)), 6) AS floor_ratio FROM bids GROUP BY 1")
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(bids(spark, sf_dir).groupBy("adexchange").agg(F.avg((F.col("bidprice") >= F.col("slotprice")).cast("int")).alias("coverage"), F.avg("slotprice").alias("floor_mean"), F.percentile("slotprice", F.lit(0.5)).alias("floor_median"), F.avg(ratio("slotprice", "bidprice")).alias("floor_ratio")))


@query("e11_floor_binding", "SELECT adexchange, round(avg(CAST(payprice = slotprice AS INT)), 6) AS binding, round(avg(CASE WHEN slotprice > 0 THEN CAST(payprice = slotprice AS INT) END), 6) AS binding_active, round(avg(payprice - slotprice), 6) AS gap FROM bids WHERE win = 1 GROUP BY 1")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("payprice") == F.col("slotprice")).cast("int")
    return r6(bids(spark, sf_dir).where("win = 1").groupBy("adexchange").agg(F.avg(at).alias("binding"), F.avg(F.when(F.col("slotprice") > 0, at)).alias("binding_active"), F.avg(F.col("payprice") - F.col("slotprice")).alias("gap")))


@query("e12_competition_slack", f"SELECT n, mean, std, p25, p50, p75, over_two FROM ({_describe_sql('least(payprice / CAST(slotprice AS DOUBLE), 10.0)', 'win = 1 AND slotprice > 0')}), (SELECT round(avg(CAST(payprice / CAST(slotprice AS DOUBLE) > 2 AS INT)), 6) AS over_two FROM bids WHERE win = 1 AND slotprice > 0)")
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = bids(spark, sf_dir).where("win = 1 and slotprice > 0").select(ratio("payprice", "slotprice").alias("r")).withColumn("clipped", F.least("r", F.lit(10.0)))
    return r6(e.describe(active, "clipped").select("n", "mean", "std", "p25", "p50", "p75").crossJoin(active.agg(F.avg((F.col("r") > 2).cast("int")).alias("over_two"))))


@query("e13_ctr", "SELECT 'hour' AS dimension, hour AS value, CAST(sum(click) AS BIGINT) AS clicks, round(sum(click) / CAST(greatest(sum(win), 1) AS DOUBLE), 6) AS ctr FROM bids GROUP BY 2 UNION ALL SELECT 'slotvisibility', slotvisibility, CAST(sum(click) AS BIGINT), round(sum(click) / CAST(greatest(sum(win), 1) AS DOUBLE), 6) FROM bids GROUP BY 2")
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    one = lambda c: e.funnel(df, c).select(F.lit(c).alias("dimension"), F.col(c).alias("value"), F.col("n_clicks").alias("clicks"), "ctr")
    return r6(one("hour").unionByName(one("slotvisibility")))


@query("e14_slot_shares", f", g AS (SELECT {_GROUP} AS slot_size_group, count(*) AS n, avg(win) AS win_rate FROM bids GROUP BY 1) SELECT slot_size_group, CAST(n AS BIGINT) AS n, round(win_rate, 6) AS win_rate, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM g")
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = f.add_slot_features(bids(spark, sf_dir)).groupBy("slot_size_group").agg(F.count("*").alias("n"), F.avg("win").alias("win_rate"))
    return r6(e.shares(g, "slot_size_group"))


@query("e15_pareto_domain", ", g AS (SELECT domain, count(*) AS n FROM bids WHERE domain IS NOT NULL GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY n DESC, domain ROWS UNBOUNDED PRECEDING) / CAST(sum(n) OVER () AS DOUBLE) AS cumulative FROM g) SELECT domain, CAST(n AS BIGINT) AS n, round(cumulative, 6) AS cumulative, CAST(sum(CAST(cumulative < 0.8 AS INT)) OVER () + 1 AS BIGINT) AS reach FROM c")
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(e.pareto(bids(spark, sf_dir), "domain"))


@query("e16_x5_top_domain_prices", ", t AS (SELECT domain FROM bids WHERE domain IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, domain LIMIT 20) SELECT domain, round(avg(payprice), 6) AS mean_pay, round(stddev_samp(payprice), 6) AS std_pay FROM bids WHERE win = 1 AND domain IN (SELECT domain FROM t) GROUP BY 1")
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    return r6(df.where("win = 1").join(e.top_keys(df, "domain", 20), "domain", "left_semi").groupBy("domain").agg(F.avg("payprice").alias("mean_pay"), F.stddev_samp("payprice").alias("std_pay")))


@query("e17_price_quantiles", "SELECT adexchange, " + ", ".join(f"round(quantile_cont(payprice, {q / 100}), 6) AS p{q}" for q in (25, 50, 75, 90, 95)) + " FROM bids WHERE win = 1 GROUP BY 1")
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs = (25, 50, 75, 90, 95)
    got = bids(spark, sf_dir).where("win = 1").groupBy("adexchange").agg(F.percentile("payprice", F.array(*[F.lit(q / 100) for q in qs])).alias("q"))
    return r6(got.select("adexchange", *[F.col("q")[i].alias(f"p{q}") for i, q in enumerate(qs)]))


@query("e18_bid_levels", ", g AS (SELECT advertiser, adexchange, bidprice, count(*) AS n, avg(win) AS win_rate FROM bids GROUP BY 1, 2, 3) SELECT advertiser, adexchange, bidprice, CAST(n AS BIGINT) AS n, round(win_rate, 6) AS win_rate, round(n / CAST(sum(n) OVER (PARTITION BY advertiser, adexchange) AS DOUBLE), 6) AS share, CAST(count(*) OVER (PARTITION BY advertiser, adexchange) AS BIGINT) AS n_levels FROM g")
def e18(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bids(spark, sf_dir).groupBy("advertiser", "adexchange", "bidprice").agg(F.count("*").alias("n"), F.avg("win").alias("win_rate"))
    keys = ["advertiser", "adexchange"]
    return r6(e.shares(g, "bidprice", keys).withColumn("n_levels", F.count("*").over(Window.partitionBy(*keys))))


@query("e19_invalid_traffic", "SELECT * FROM (SELECT domain, CAST(count(*) AS BIGINT) AS n, CAST(sum(win) AS BIGINT) AS w, CAST(sum(click) AS BIGINT) AS c, CASE WHEN sum(win) = 0 THEN 'zero_win' WHEN sum(win) > 0.9 * count(*) THEN 'high_win' WHEN sum(win) >= 5 AND sum(click) = 0 THEN 'zero_click' END AS flag FROM bids WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) WHERE flag IS NOT NULL")
def e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.invalid_traffic(bids(spark, sf_dir), 5)


@query("e20_volume_shares", ", g AS (SELECT advertiser, adexchange, count(*) AS n FROM bids GROUP BY 1, 2) SELECT advertiser, adexchange, CAST(n AS BIGINT) AS n, round(n / CAST(sum(n) OVER (PARTITION BY advertiser) AS DOUBLE), 6) AS row_share, round(n / CAST(sum(n) OVER (PARTITION BY adexchange) AS DOUBLE), 6) AS column_share FROM g")
def e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = bids(spark, sf_dir).groupBy("advertiser", "adexchange").agg(F.count("*").alias("n"))
    return r6(e.shares(e.shares(g, "", ["advertiser"], "row_share"), "", ["adexchange"], "column_share"))


@query("e21_season_hours", f"SELECT season, hour, {_SUMS}, round(avg(bidprice), 6) AS mean_bid, {_RATES}, round(avg(slotprice), 6) AS mean_floor FROM bids GROUP BY 1, 2")
def e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    return r6(e.funnel(df, "season", "hour").join(df.groupBy("season", "hour").agg(F.avg("slotprice").alias("mean_floor")), ["season", "hour"]))


@query("e22_weekdays", f", d AS (SELECT *, {_WD} AS weekday FROM bids) SELECT weekday, CAST(weekday >= 5 AS INT) AS is_weekend, CAST(count(*) AS BIGINT) AS n, round(avg(win), 6) AS win_rate, round(sum(click) / CAST(greatest(sum(win), 1) AS DOUBLE), 6) AS ctr, round(avg(CASE WHEN win = 1 THEN payprice END), 6) AS mean_pay, round(quantile_cont(CASE WHEN win = 1 THEN payprice END, 0.5), 6) AS median_pay FROM d GROUP BY 1, 2")
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.when(F.col("win") == 1, F.col("payprice"))
    ctr = F.sum("click") / F.greatest(F.sum("win"), F.lit(1)).cast("double")
    return r6(f.add_time_features(bids(spark, sf_dir)).groupBy("weekday", "is_weekend").agg(F.count("*").alias("n"), F.avg("win").alias("win_rate"), ctr.alias("ctr"), F.avg(paid).alias("mean_pay"), F.percentile(paid, F.lit(0.5)).alias("median_pay")))


@query("e23_taxonomy_rollup", f", t AS (SELECT *, {_KIND} AS taxonomy FROM bids) SELECT taxonomy, {_SUMS}, {_RATES} FROM t GROUP BY 1")
def e23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(e.roll_up(f.add_taxonomy(e.funnel(bids(spark, sf_dir), "advertiser")), "taxonomy"))


@query("e24_positivity", ", g AS (SELECT hour, adexchange, domain, count(*) AS n, avg(win) AS r FROM bids GROUP BY 1, 2, 3) SELECT CAST(count(*) AS BIGINT) AS n_strata, CAST(count(*) FILTER (r = 0) AS BIGINT) AS n_zero, CAST(count(*) FILTER (r < 0.01 OR r > 0.99) AS BIGINT) AS n_extreme, round(coalesce(sum(n) FILTER (r < 0.01 OR r > 0.99), 0) / CAST(sum(n) AS DOUBLE), 6) AS extreme_share FROM g")
def e24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(e.positivity(bids(spark, sf_dir), ["hour", "adexchange", "domain"]))


@query("e25_domain_drift", ", a AS (SELECT domain, count(*) / CAST((SELECT count(*) FROM bids WHERE season = 2) AS DOUBLE) AS s FROM bids WHERE season = 2 GROUP BY 1), b AS (SELECT domain, count(*) / CAST((SELECT count(*) FROM bids WHERE season = 3) AS DOUBLE) AS s FROM bids WHERE season = 3 GROUP BY 1) SELECT round(0.5 * sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), 6) AS distance FROM a FULL JOIN b ON a.domain IS NOT DISTINCT FROM b.domain")
def e25(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    return r6(e.total_variation(df.where("season = 2"), df.where("season = 3"), "domain"))


@query("e26_hourly_correlation", ", h AS (SELECT hour, avg(win) AS wr, sum(click) / CAST(greatest(sum(win), 1) AS DOUBLE) AS ctr FROM bids GROUP BY 1) SELECT round(corr(wr, ctr), 6) AS correlation FROM h")
def e26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(e.funnel(bids(spark, sf_dir), "hour").agg(F.corr("win_rate", "ctr").alias("correlation")))


_TAGS = ", tg AS (SELECT bidid, click, CAST(unnest(string_split(usertag, ',')) AS BIGINT) AS tag FROM bids WHERE usertag IS NOT NULL)"


@query("e27_over_represented_tags", f"{_TAGS}, s AS (SELECT tag, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS a, sum(click) / CAST(sum(sum(click)) OVER () AS DOUBLE) AS c FROM tg GROUP BY 1) SELECT tag, round(c - a, 6) AS diff FROM s ORDER BY abs(round(c - a, 9)) DESC, tag LIMIT 10")
def e27(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = e.add_tags(bids(spark, sf_dir)).select("click", F.explode("tags").alias("tag"))
    total = Window.partitionBy()
    g = long.groupBy("tag").agg(F.count("*").alias("n"), F.sum("click").alias("c"))  # the window below holds one row for each tag
    diff = g.select("tag", (F.col("c") / F.sum("c").over(total) - F.col("n") / F.sum("n").over(total)).alias("diff"))
    return r6(diff.orderBy(F.desc(F.abs(F.round("diff", 9))), "tag").limit(10))


@query("e28_ks", ", g AS (SELECT payprice AS v, sum(CAST(season = 2 AS INT)) AS a, sum(CAST(season = 3 AS INT)) AS b FROM bids WHERE win = 1 GROUP BY 1), c AS (SELECT abs(sum(a) OVER (ORDER BY v) / CAST(sum(a) OVER () AS DOUBLE) - sum(b) OVER (ORDER BY v) / CAST(sum(b) OVER () AS DOUBLE)) AS d, a, b FROM g) SELECT round(max(d), 6) AS ks, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n0 FROM c")
def e28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(e.ks(bids(spark, sf_dir).where("win = 1"), F.col("season") == 2, "payprice"))


@query("e29_quartile_composition", ", q AS (SELECT quantile_cont(p_a, 0.25) AS lo, quantile_cont(p_a, 0.75) AS hi FROM bids) SELECT grp, adexchange, CAST(count(*) AS BIGINT) AS n, round(avg(slotprice), 6) AS mean_floor FROM (SELECT CASE WHEN p_a <= lo THEN 'low' WHEN p_a >= hi THEN 'high' END AS grp, adexchange, slotprice FROM bids, q) WHERE grp IS NOT NULL GROUP BY 1, 2")
def e29(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir)
    q = quantiles(df, "p_a", [0.25, 0.75]).agg(F.min("edge").alias("lo"), F.max("edge").alias("hi"))
    grp = F.when(F.col("p_a") <= F.col("lo"), "low").when(F.col("p_a") >= F.col("hi"), "high")
    return r6(df.crossJoin(F.broadcast(q)).withColumn("grp", grp).where("grp is not null").groupBy("grp", "adexchange").agg(F.count("*").alias("n"), F.avg("slotprice").alias("mean_floor")))


@query("e30_population_ctr", f", t AS (SELECT *, {_KIND} AS segment FROM bids), g AS (SELECT advertiser, segment, avg(win) AS wr, sum(click) / CAST(greatest(sum(win), 1) AS DOUBLE) AS ctr, sum(click) AS c FROM t GROUP BY 1, 2) SELECT advertiser, segment, round(wr * ctr, 6) AS population_ctr, round(sum(c) OVER (PARTITION BY segment) / CAST(sum(c) OVER () AS DOUBLE), 6) AS segment_click_share FROM g")
def e30(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = f.add_taxonomy(e.funnel(bids(spark, sf_dir), "advertiser"))
    share = F.sum("n_clicks").over(Window.partitionBy("taxonomy")) / F.sum("n_clicks").over(Window.partitionBy())
    return r6(g.select("advertiser", F.col("taxonomy").alias("segment"), (F.col("win_rate") * F.col("ctr")).alias("population_ctr"), share.alias("segment_click_share")))


# --- tags -------------------------------------------------------------------

_VOCAB = f"{_TAGS}, vo AS (SELECT tag, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tag) AS idx FROM tg GROUP BY 1 HAVING count(*) >= 5 ORDER BY 3 LIMIT 30), ix AS (SELECT bidid, coalesce(idx, 0) AS idx FROM tg LEFT JOIN vo USING (tag))"


def _vocab(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = e.add_tags(bids(spark, sf_dir))
    return df, e.tag_vocabulary(df, 30, 5)


@query("u1_u2_tags", "SELECT bidid, CAST(CASE WHEN usertag IS NULL THEN 0 ELSE len(string_split(usertag, ',')) END AS INT) AS n_tags, CAST(usertag IS NOT NULL AS INT) AS has_tags FROM bids")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.add_tags(bids(spark, sf_dir)).select("bidid", "n_tags", "has_tags")


@query("u3_vocabulary", f"{_VOCAB} SELECT tag, CAST(n AS BIGINT) AS n, CAST(idx AS INT) AS idx FROM vo")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir)[1]


@query("u4_multi_hot", f"{_VOCAB} SELECT DISTINCT bidid, CAST(idx AS INT) AS idx, CAST(1.0 AS DOUBLE) AS value FROM ix")
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.multi_hot(*_vocab(spark, sf_dir))


@query("u5_tag_counts", f"{_VOCAB} SELECT bidid, CAST(idx AS INT) AS idx, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY bidid) AS DOUBLE), 6) AS value FROM ix GROUP BY 1, 2")
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(e.tag_counts(*_vocab(spark, sf_dir), normalise=True))


_TAG_HASHES = f"""{_TAGS}{hash_sql('ha', 'tg', 'tag', 42)}{hash_sql('hb', 'tg', 'tag', 43)}
SELECT bidid, CAST(ha.h % CAST('64' AS UHUGEINT) AS BIGINT) AS idx, CAST(sum(CASE WHEN hb.h % CAST('2' AS UHUGEINT) = 0 THEN 1.0 ELSE -1.0 END) AS DOUBLE) AS value FROM tg JOIN ha USING (tag) JOIN hb USING (tag) GROUP BY 1, 2"""


@query("u6_tag_hashes", _TAG_HASHES)
def u6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.tag_hashes(e.add_tags(bids(spark, sf_dir)), 64)


@query("u7_tag_columns", f"{_VOCAB} SELECT bids.bidid, " + ", ".join(f"CAST(max(CASE WHEN idx = {i} THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS tag_{i}" for i in range(6)) + " FROM bids LEFT JOIN ix ON bids.bidid = ix.bidid GROUP BY 1")
def u7(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, vocab = _vocab(spark, sf_dir)
    return e.with_tag_columns(df.select("bidid"), e.multi_hot(df, vocab), 5)


@query("u8_tag_statistics", f"{_TAGS} SELECT tag, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / (SELECT count(*) FROM bids), 6) AS percent FROM tg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(e.tag_statistics(e.add_tags(bids(spark, sf_dir))))


@query("u9_coverage", f"{_VOCAB} SELECT round(avg(CAST(idx > 0 AS INT)), 6) AS coverage FROM ix")
def u9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(e.tag_coverage(*_vocab(spark, sf_dir)))


# --- windows, sorts, set operations ------------------------------------------


@query("z1_z2_windows", ", g AS (SELECT advertiser, hour, sum(payprice) AS spend FROM bids GROUP BY 1, 2) SELECT advertiser, hour, CAST(spend AS BIGINT) AS spend, CAST(spend - lag(spend) OVER o AS BIGINT) AS change, CAST(sum(spend) OVER o AS BIGINT) AS running, CAST(max(spend) OVER o AS BIGINT) AS peak, CAST(rank() OVER (PARTITION BY advertiser ORDER BY spend DESC) AS INT) AS place FROM g WINDOW o AS (PARTITION BY advertiser ORDER BY hour)")
def z1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Window.partitionBy("advertiser").orderBy("hour")
    g = bids(spark, sf_dir).groupBy("advertiser", "hour").agg(F.sum("payprice").alias("spend"))
    return g.select("advertiser", "hour", "spend", (F.col("spend") - F.lag("spend").over(o)).alias("change"), F.sum("spend").over(o).alias("running"), F.max("spend").over(o).alias("peak"), F.rank().over(Window.partitionBy("advertiser").orderBy(F.desc("spend"))).alias("place"))


@query("z3_top_bids", "SELECT bidid, payprice FROM bids ORDER BY payprice DESC, bidid LIMIT 50")
def z3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids(spark, sf_dir).select("bidid", "payprice").orderBy(F.desc("payprice"), "bidid").limit(50)


@query("z4_set_operations", ", a AS (SELECT DISTINCT domain FROM bids WHERE season = 2 AND domain IS NOT NULL), b AS (SELECT DISTINCT domain FROM bids WHERE season = 3 AND domain IS NOT NULL) SELECT CAST((SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS BIGINT) AS n_union, CAST((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS BIGINT) AS n_both, CAST((SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS BIGINT) AS n_gone")
def z4(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bids(spark, sf_dir).where("domain is not null")
    a, b = (df.where(f"season = {s}").select("domain").distinct() for s in (2, 3))
    count = lambda t, n: t.agg(F.count("*").alias(n))
    return count(a.union(b).distinct(), "n_union").crossJoin(count(a.intersect(b), "n_both")).crossJoin(count(a.exceptAll(b), "n_gone"))


@query("z5_tag_rows", ", tg AS (SELECT bidid, string_split(usertag, ',') AS t FROM bids WHERE usertag IS NOT NULL) SELECT bidid, CAST(i AS INT) AS place, CAST(t[i + 1] AS INT) AS tag FROM (SELECT bidid, t, unnest(range(len(t))) AS i FROM tg)")
def z5t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python table function over user tags."""
    return e.tag_rows(bids(spark, sf_dir))


def _entropy(values: pd.Series, counts: pd.Series) -> float:
    p = counts / counts.sum()
    return float(-(p * np.log(p)).sum())


def _gini(values: pd.Series, counts: pd.Series) -> float:
    """Mean absolute difference of two draws, over twice the mean."""
    order = np.argsort(values.to_numpy(), kind="stable")
    v, n = values.to_numpy(float)[order], counts.to_numpy(float)[order]
    below = np.cumsum(n) - n
    return float((v * n * (2 * below + n)).sum() / (n.sum() * (v * n).sum()) - 1)


_REDUCED = """, pc AS (SELECT adexchange, payprice, CAST(count(*) AS DOUBLE) AS n FROM bids WHERE win = 1 GROUP BY 1, 2),
pt AS (SELECT *, sum(n) OVER (PARTITION BY adexchange) AS a, sum(n) OVER (PARTITION BY adexchange ORDER BY payprice) - n AS below FROM pc)
SELECT adexchange, round(-sum(n / a * ln(n / a)), 6) AS entropy, round(sum(payprice * n * (2 * below + n)) / (any_value(a) * sum(payprice * n)) - 1, 6) AS gini FROM pt GROUP BY 1"""


@query("z5_reduced_prices", _REDUCED)
def z5r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python reducers of paid prices as arguments: entropy and Gini coefficient by exchange."""
    return r6(e.reduce_counts(bids(spark, sf_dir).where("win = 1"), ["adexchange"], "payprice", {"entropy": _entropy, "gini": _gini}))
