"""Fits against numpy, closed forms and planted effects."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gavel.operators import debias, effects, market


def newton(x, y, rounds=30):
    """Coefficients of a logistic regression with an intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return b


@pytest.fixture(scope="module")
def rows():
    """Bids whose price falls with the control, by a planted click effect of 0.3 and a true win model."""
    rng = np.random.default_rng(8)
    n = 3_000
    slot = rng.normal(50, 10, n)
    arm = (rng.random(n) < 1 / (1 + np.exp(-(slot - 50) / 10))).astype(int)
    bid = np.where(arm == 1, 300, 200)
    win = (rng.random(n) < 1 / (1 + np.exp(-(bid - 250) / 60 + (slot - 50) / 15))).astype(int)
    outcome = 0.3 * arm + 0.02 * slot + rng.normal(0, 0.2, n)
    click = (win * (rng.random(n) < 0.2 + 0.004 * (slot - 50))).astype(int)
    return pd.DataFrame({"bidid": np.arange(n), "slotprice": slot.round(3), "bidprice": bid, "hour": rng.integers(0, 24, n), "region": rng.integers(0, 35, n), "slotwidth": 300, "slotheight": rng.integers(0, 2, n) * 160 + 90, "arm": arm, "win": win, "click": click, "outcome": outcome, "advertiser": rng.integers(0, 3, n)})


def test_back_door_is_least_squares(spark, rows):
    got = effects.back_door(spark.createDataFrame(rows), "outcome", ["slotprice", "hour"]).first()
    x = np.column_stack([rows["bidprice"], rows["slotprice"], rows["hour"], np.ones(len(rows))])
    b, rss, *_ = np.linalg.lstsq(x, rows["outcome"], rcond=None)
    se = math.sqrt(rss[0] / (len(rows) - 4) * np.linalg.inv(x.T @ x)[0, 0])
    assert got["beta"] == pytest.approx(b[0], rel=1e-6)
    assert (got["ci_lo"], got["ci_hi"]) == pytest.approx((b[0] - 1.959964 * se, b[0] + 1.959964 * se), rel=1e-5)
    assert got["ipw"] == pytest.approx(0.3, abs=0.05)


def test_refutations_keep_or_lose_the_effect(spark, rows):
    got = {r["test"]: r for r in effects.refute(spark.createDataFrame(rows), "outcome", ["slotprice"]).collect()}
    assert got["random_control"]["effect"] == pytest.approx(0.003, rel=0.1)
    assert got["random_control"]["passed"] == got["subset"]["passed"] == 1
    assert abs(got["permuted"]["again"]) < 0.1 * abs(got["permuted"]["effect"])


def test_learners_find_the_planted_effect(spark, rows):
    df = spark.createDataFrame(rows).cache()
    assert effects.t_learner(df, "outcome", ["slotprice", "hour"]).agg(F.avg("cate")).first()[0] == pytest.approx(0.3, abs=0.05)
    found = effects.dr_learner(df, "outcome", ["slotprice", "hour"]).agg(F.avg("psi"), F.avg("cate"), F.count("*")).first()
    assert found[0] == pytest.approx(0.3, abs=0.04) and found[1] == pytest.approx(0.3, abs=0.04) and found[2] == len(rows)
    df.unpersist()


def test_propensity_is_the_logistic_fit(spark, rows):
    df = spark.createDataFrame(rows)
    names = ["slotprice", "bidprice"]
    got = debias.apply_probability(debias.fit_probability(df, "win", names), df, "e").orderBy("bidid").toPandas()
    x = rows[names].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    b = newton(x, rows["win"].to_numpy())
    assert np.allclose(got["e"], 1 / (1 + np.exp(-(b[0] + x @ b[1:]))), atol=1e-4)


def test_doubly_robust_regresses_pseudo_labels(spark, rows):
    names = debias.FEATURES
    df = spark.createDataFrame(rows.drop(columns="slotwidth").assign(e=0.5, slotwidth=rows["hour"] % 3 + 300))
    got = debias.doubly_robust(df).orderBy("bidid").toPandas()
    won = df.where("win = 1")
    g = debias.apply_probability(debias.fit_probability(won, "click"), df, "g").orderBy("bidid").toPandas()
    pseudo = np.clip(g["g"] + g["win"] / 0.5 * (g["click"] - g["g"]), 0, 1)
    x = np.column_stack([g[names].to_numpy(float), np.ones(len(g))])
    b = np.linalg.lstsq(x, pseudo, rcond=None)[0]
    assert np.allclose(got["p_dr"], np.clip(x @ b, 0, 1), atol=1e-6)


def test_logistic_win_rate(spark):
    rng = np.random.default_rng(4)
    bid, floor = rng.integers(50, 300, 2_000), rng.integers(0, 3, 2_000) * 20
    x = np.log(bid / np.maximum(floor, 1))
    win = (rng.random(2_000) < 1 / (1 + np.exp(-(x - 2.5)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(2_000) % 2, "bidprice": bid, "slotprice": floor, "win": win}))
    b = newton(x[:, None], win)
    p = 1 / (1 + np.exp(-(b[0] + b[1] * x)))
    for r in market.logistic_win_rate(df, "k").collect():
        mine = np.arange(2_000) % 2 == r["k"]
        assert r["beta"] == pytest.approx(b[1], abs=1e-4)
        assert r["mean_p"] == pytest.approx(p[mine].mean(), abs=1e-4)
        assert r["elasticity"] == pytest.approx((b[1] * (1 - p[mine])).mean(), abs=1e-4)


def test_parametric_fits(spark):
    rng = np.random.default_rng(5)
    price, bid = np.ceil(rng.weibull(1.5, 4_000) * 80), rng.integers(20, 200, 4_000)
    win = (price <= bid).astype(int)
    log = pd.DataFrame({"bidprice": bid, "payprice": np.where(win == 1, price, 0).astype(int), "win": win, "slotprice": 0})
    got = {r["distribution"]: r for r in market.parametric_fits(spark.createDataFrame(log)).collect()}
    t = np.where(win == 1, price, bid)
    # The exponential's rate has a closed form: events by the time at risk.
    assert math.exp(-got["exponential"]["a"]) == pytest.approx(win.sum() / t.sum(), rel=1e-4)
    assert min(got, key=lambda k: got[k]["aic"]) == "weibull"
    assert math.exp(got["weibull"]["a"]) == pytest.approx(80, rel=0.05) and math.exp(got["weibull"]["b"]) == pytest.approx(1.5, rel=0.05)
    for name, r in got.items():
        n = 1 if name == "exponential" else 2
        assert r["aic"] == pytest.approx(2 * n - 2 * r["log_likelihood"]) and r["bic"] == pytest.approx(n * math.log(4_000) - 2 * r["log_likelihood"])
    # No step from the Weibull's end raises its likelihood.
    a, b = got["weibull"]["a"], got["weibull"]["b"]

    def like(u, v):
        z = math.exp(v) * (np.log(t) - u)
        return float((win * (v + z - np.log(t)) - np.exp(z)).sum())

    assert like(a, b) == pytest.approx(got["weibull"]["log_likelihood"], abs=1e-6)
    assert all(like(a + d, b + c) <= like(a, b) + 1e-6 for d, c in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01), (0.01, 0.01), (-0.01, -0.01)))
    assert all(r["converged"] == 1 for r in got.values())
    # The log-normal's end against its likelihood in plain Python.
    tail = np.vectorize(lambda z: math.log(0.5 * math.erfc(z / math.sqrt(2))))

    def log_normal(m, v):
        z = (np.log(t) - m) / math.exp(v)
        return float(np.where(win == 1, -np.log(t) - v - 0.5 * math.log(2 * math.pi) - z**2 / 2, tail(z)).sum())

    a, b = got["lognormal"]["a"], got["lognormal"]["b"]
    assert log_normal(a, b) == pytest.approx(got["lognormal"]["log_likelihood"], abs=1e-2)
    assert all(log_normal(a + d, b + c) <= log_normal(a, b) for d, c in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)))


def test_parametric_curves(spark):
    """Distribution and density in closed form; the density is the distribution's slope."""
    fits = spark.createDataFrame([("exponential", math.log(90.0), 0.0), ("weibull", math.log(80.0), math.log(1.5)), ("lognormal", 4.2, math.log(0.6))], "distribution string, a double, b double")
    got = {(r["distribution"], r["price"]): r for r in market.parametric_curves(fits, 250).collect()}
    assert len(got) == 750
    normal = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    for t in (1.0, 40.0, 80.0, 250.0):
        assert got["exponential", t]["cdf"] == pytest.approx(1 - math.exp(-t / 90)) and got["exponential", t]["pdf"] == pytest.approx(math.exp(-t / 90) / 90)
        assert got["weibull", t]["cdf"] == pytest.approx(1 - math.exp(-((t / 80) ** 1.5)))
        assert got["lognormal", t]["cdf"] == pytest.approx(normal((math.log(t) - 4.2) / 0.6), abs=1e-6)
    for name in ("exponential", "weibull", "lognormal"):
        for t in (30.0, 100.0, 200.0):
            assert (got[name, t + 1]["cdf"] - got[name, t - 1]["cdf"]) / 2 == pytest.approx(got[name, t]["pdf"], rel=0.02)


def test_newton_says_when_there_is_no_maximum(spark):
    df = spark.createDataFrame([(1, b, 0, int(b > 100)) for b in range(50, 150)], "k int, bidprice int, slotprice int, win int")
    got = market.logistic_win_rate(df, "k").first()
    assert got["converged"] == 0 or got["mean_p"] == pytest.approx(0.49, abs=0.01)
    assert market.parametric_fits(df.where("1 = 0").withColumn("payprice", F.lit(1))).count() == 3


def test_fits_after_an_observation(spark, rows):
    """A session that was observed can't be serialised; fits and their scores don't depend on that."""
    from pyspark.sql import Observation

    spark.range(3).observe(Observation(), F.count("*").alias("n")).collect()
    df = spark.createDataFrame(rows)
    model = debias.fit_probability(df, "win", ["slotprice", "bidprice"])
    assert debias.apply_probability(model, df, "e").where("e between 0 and 1").count() == len(rows)
    assert effects.back_door(df, "outcome", ["slotprice"]).count() == 1
    assert debias.doubly_robust(df.withColumn("e", F.lit(0.5))).count() == len(rows)


def test_importances_name_the_features_that_matter(spark, rows):
    """Wins follow the bid and the slot's price; hours and the rest are noise."""
    df = spark.createDataFrame(rows.assign(split=np.where(rows["bidid"] % 5 < 3, "train", np.where(rows["bidid"] % 5 == 3, "val", "test"))))
    names = ["slotprice", "bidprice", "hour", "slotheight"]
    table, weights = debias.baseline_report(df, features=names)
    got = table.toPandas()
    assert len(got) == 3 * 2 * 3 and set(got["split"]) == {"train", "val", "test"}
    win = got[(got["task"] == "win") & (got["split"] == "test")]
    assert (win["auc"] > 0.65).all() and (win["log_loss"] < 0.7).all() and {"ece", "brier", "f1", "ieb"} <= set(got.columns)
    w = weights.toPandas()
    assert np.allclose(w.groupby(["task", "model"])["importance"].sum(), 1) and len(w) == 6 * len(names)
    own = {k: w[(w["task"] == "win") & (w["model"] == k)].set_index("feature") for k in ("linear", "trees")}
    assert set(own["linear"].nsmallest(2, "rank").index) == {"slotprice", "bidprice"}
    assert own["trees"]["importance"].idxmax() == "slotprice" and own["trees"].loc["bidprice", "importance"] > own["trees"].loc["slotheight", "importance"]


def test_a_linear_model_as_numbers_scores_as_its_pipeline(spark, rows):
    df = spark.createDataFrame(rows)
    names = ["slotprice", "bidprice", "slotwidth"]  # the last is constant
    pipeline = debias.apply_probability(debias.fit_pipeline(df, "win", names), df, "e").orderBy("bidid").toPandas()
    model = debias.fit_probability(df, "win", names)
    assert isinstance(model, debias.LinearProbability)
    assert np.allclose(debias.apply_probability(model, df, "e").orderBy("bidid").toPandas()["e"], pipeline["e"], atol=1e-9)


@pytest.mark.parametrize("cluster", [None, "c"])
def test_intervals_cover_the_planted_effect(spark, cluster):
    """400 experiments at once: about 95 percent of the intervals hold the effect; rows that share a cluster's shock need the clusters."""
    rng = np.random.default_rng(9)
    parts = []
    for seed in range(400):
        c = np.repeat(np.arange(40), 6)
        arm = (rng.random(240) < 0.4).astype(int)
        shock = rng.normal(0, 1.0, 40)[c] if cluster else 0.0
        y = 1.0 + 0.5 * arm + shock * (2 * arm - 1) * 0.5 + rng.normal(0, 1, 240)
        parts.append(pd.DataFrame({"seed": seed, "c": c, "arm": arm, "y": y, "m1": 1.5, "m0": 1.0, "e": 0.4}))
    df = spark.createDataFrame(pd.concat(parts))
    df = df.withColumn("psi", effects.pseudo_outcome(F.col("y"), F.col("m1"), F.col("m0"), F.col("e")))
    got = effects.effect_interval(df, "seed", cluster=cluster).toPandas()
    held = ((got["ci_lo"] <= 0.5) & (got["ci_hi"] >= 0.5)).mean()
    assert 0.92 <= held <= 0.98 and (got["n"] == 240).all() and (got["units"] == (40 if cluster else 240)).all()


def test_a_permutation_deals_all_values_anew(spark):
    df = spark.range(500).select(F.col("id").alias("bidid"), (F.col("id") * 3).alias("v"), F.lit("x").alias("other"))
    got = effects.permuted(df, "v").toPandas()
    assert sorted(got["v"]) == [3 * i for i in range(500)] and sorted(got["bidid"]) == list(range(500))
    assert (got["v"] == 3 * got["bidid"]).sum() < 10 and abs(np.corrcoef(got["v"], got["bidid"])[0, 1]) < 0.15
