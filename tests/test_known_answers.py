"""Small inputs with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gavel.functions import tails
from gavel.functions.columns import hash_bucket, wilson
from gavel.operators import bidding, effects, explore, features, market, metrics, monotone


def scored(spark, pairs):
    rows = [(i, float(p), int(y)) for i, (p, y) in enumerate(pairs)]
    return spark.createDataFrame(rows, "bidid long, p double, click int")


def test_ece(spark):
    df = scored(spark, [(0.05, 1)] + [(0.05, 0)] * 3 + [(0.95, 1)] * 3 + [(0.95, 0)] * 3)
    assert metrics.ece(df).first()["ece"] == pytest.approx(0.35)
    assert metrics.ece(scored(spark, [(1.0, 0)])).first()["ece"] == 0.0


def test_ieb(spark):
    df = scored(spark, [(0.3, 1)] + [(0.3, 0)] * 4)
    assert df.agg(metrics.ieb().alias("x")).first()["x"] == pytest.approx(0.5)
    assert scored(spark, [(1e-9, 0)] * 3).agg(metrics.ieb().alias("x")).first()["x"] == pytest.approx(0.1)


def test_quantile_ece(spark):
    df = scored(spark, [(0.2, 1)] * 5 + [(0.2, 0)] * 45 + [(0.8, 1)] * 30 + [(0.8, 0)] * 20)
    table = metrics.reliability(df, n=2)
    assert metrics.quantile_ece(table).first()["quantile_ece"] == pytest.approx(0.15)
    assert sorted(round(r["bias"], 6) for r in table.collect()) == [0.1, 0.2]


def test_auc_ties_and_one_class(spark):
    df = scored(spark, [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)])
    p, y = np.array([0.1, 0.4, 0.35, 0.8, 0.4]), np.array([0, 0, 1, 1, 1])
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert metrics.auc(df).first()["auc"] == pytest.approx(np.mean(pairs))
    assert metrics.auc(scored(spark, [(0.1, 0)])).first()["auc"] is None


def test_isotonic_keeps_ranks(spark):
    rng = np.random.default_rng(1)
    p = rng.random(400).round(3)
    df = scored(spark, zip(p, rng.random(400) < p**2, strict=True))
    got = metrics.isotonic(df, df).orderBy("p").toPandas()
    assert (np.diff(got["calibrated"]) >= -1e-12).all()
    assert abs(got["calibrated"].mean() - got["click"].mean()) < 1e-9
    cross = metrics.cross_fit(df).toPandas()
    assert sorted(cross["bidid"]) == list(range(400))


def test_kaplan_meier(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(500):
        m, b = int(rng.integers(1, 60)), int(rng.integers(1, 60))
        rows.append((i, b, m if m <= b else 0, int(m <= b), 0))
    df = spark.createDataFrame(rows, "bidid long, bidprice int, payprice int, win int, slotprice int")
    got = market.kaplan_meier(df).orderBy("price").toPandas()
    t = np.array([r[2] if r[3] else r[1] for r in rows])
    e = np.array([r[3] for r in rows])
    s, want = 1.0, []
    for x in np.unique(t):
        s *= 1 - e[t == x].sum() / (t >= x).sum()
        want.append(s)
    assert np.allclose(got["survival"], want, atol=1e-9)


def test_envelope_equals_grid_search(spark):
    rng = np.random.default_rng(3)
    cdf = np.sort(rng.random(301))
    cdf[:5] = 0
    grid = spark.createDataFrame([(1, float(i), float(c), 0.0) for i, c in enumerate(cdf)], "k int, price double, cdf double, spend double")
    values = rng.random(200) * 500
    df = spark.createDataFrame([(1, float(v)) for v in values], "k int, v double")
    got = df.join(bidding.envelope(grid, "k"), "k").select("v", bidding.best_bid(F.col("v")).alias("bid")).toPandas()
    for v, bid in zip(got["v"], got["bid"], strict=True):
        gain = (v - np.arange(1, 301)) * cdf[1:]
        assert (v - bid) * cdf[int(bid)] == pytest.approx(gain.max(), abs=1e-9)
        assert bid <= max(v, 1)


@pytest.mark.parametrize(("v", "want"), [(50, 50), (100, 100), (250, 250), (400, 300)])
def test_truthful_under_uniform_market(spark, v, want):
    grid = spark.createDataFrame([(1, float(i), i / 300) for i in range(301)], "k int, price double, cdf double")
    hull = bidding.envelope(market.market_model(grid, "k"), "k", second_price=True)
    got = hull.select(bidding.best_bid(F.lit(float(v))).alias("b")).first()["b"]
    assert abs(got - want) <= 2


def policy(spark, win, logged, bid, pay, click, p, cdf):
    spend = np.concatenate([[0], np.cumsum(np.diff(cdf) * (np.arange(300) + 0.5))])
    row = [(win, logged, float(bid), pay, click, p, [float(x) for x in cdf], [float(x) for x in spend])]
    df = spark.createDataFrame(row, "win int, bidprice int, bid double, payprice int, click int, p double, cdf_grid array<double>, spend_grid array<double>")
    return bidding.policy_value(df).first()


def test_policy_value(spark):
    step = (np.arange(301) >= 150).astype(float)
    assert policy(spark, 0, 120, 250, 0, 0, 0.02, step)["s"] == pytest.approx(0.02 * 200_000 - 150, abs=2)
    assert policy(spark, 0, 200, 100, 0, 0, 0.02, step)["s"] == 0
    assert policy(spark, 1, 200, 150, 100, 1, 0.02, step)["s"] == 200_000 - 100


def test_clusters():
    found = effects.heterogeneity(pd.DataFrame({"gap": [10.0] * 5, "se": [2.0] * 5}))
    assert (found["q"], found["i2"], found["tau2"], found["fixed_effect"]) == (0, 0, 0, 10)
    assert effects.heterogeneity(pd.DataFrame({"gap": [10.0, 0.0], "se": [1.0, 10.0]}))["fixed_effect"] == pytest.approx(10, abs=0.2)
    assert effects.sign_test(pd.Series([1.0] * 5))["p_greater"] == 0.5**5
    assert effects.sign_test(pd.Series([11, 0.9, -0.6, -2.6, -5.1]))["k_pos"] == 2


def test_tails():
    assert tails.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_sf(22.04, 4) == pytest.approx(0.000197, abs=2e-6)
    assert tails.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5)
    assert tails.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_wilson(spark):
    lo, hi = spark.range(1).select(*wilson(F.lit(8), F.lit(10))).first()
    assert (lo, hi) == (pytest.approx(0.490162, abs=1e-5), pytest.approx(0.943318, abs=1e-5))
    assert spark.range(1).select(wilson(F.lit(0), F.lit(0))[0]).first()[0] is None


def test_hash_bucket(spark):
    import hashlib

    rows = spark.createDataFrame([("a",), ("domain-é",), (None,)], "v string").select("v", hash_bucket("v", 10_000).alias("h")).collect()
    for r in rows:
        want = 0 if r["v"] is None else int(hashlib.md5(f"{r['v']}_42".encode()).hexdigest(), 16) % 10_000 + 1
        assert r["h"] == want


def test_time_features_and_bad_dates(spark):
    df = spark.createDataFrame([("20130606083015000",), ("20139906083015000",)], "timestamp string")
    a, b = features.add_time_features(df).collect()
    assert (a["hour"], a["minute"], a["weekday"], a["is_peak_hour"]) == (8, 30, 3, 1)
    assert b["weekday"] is None


def test_parse_tags(spark):
    rows = [("1,2",), (" 3 ,4",), ("1,x",), ("",), ("null",), ("nan",), (None,)]
    got = [r["t"] for r in spark.createDataFrame(rows, "usertag string").select(explore.parse_tags().alias("t")).collect()]
    assert got == [[1, 2], [3, 4], [], [], [], [], []]


def test_pool_adjacent():
    held = monotone.Stack()
    for x, y in zip(np.arange(4.0), [1.0, 3.0, 2.0, 4.0], strict=True):
        held.push(x, x, y, 1.0)
    assert [(lo, hi, s / w) for lo, hi, s, w in held.blocks] == [(0.0, 0.0, 1.0), (1.0, 2.0, 2.5), (3.0, 3.0, 4.0)]


def test_bootstrap(spark):
    rows = [(i, 1.0 + (i % 7), 0.5, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "bidid long, a double, b double, c int")
    first, again = (bidding.paired_bootstrap(df, "a", "b", 200).first() for _ in range(2))
    assert first == again and first["p_positive"] == 1.0 and first["ci_lo"] < first["gap"] < first["ci_hi"]
    assert bidding.paired_bootstrap(df.where("1 = 0"), "a", "b", 20).first()["gap"] == 0
    assert bidding.cluster_bootstrap(df, "c", "a", "b", 200).first()["n_clusters"] == 5


def test_second_price_is_never_worse(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(1, 300)), int(rng.integers(1, 300)), float(rng.integers(1, 300)), 0) for i in range(200)]
    df = spark.createDataFrame(rows, "bidid long, bid double, payprice int, v double, click int")
    one = lambda s: bidding.settlement_metrics(bidding.settle(df, s)).first()
    assert one(True)["surplus"] >= one(False)["surplus"] and one(True)["wins"] == one(False)["wins"]
    assert one(True)["cpc"] is None


def test_pid_recurrence(spark):
    hours = spark.createDataFrame([(1, 1, h, 10 * (h % 5)) for h in range(24)], "advertiser int, day long, hour int, spend int")
    ideal = spark.createDataFrame([(h, 20.0 * (h + 1)) for h in range(24)], "hour int, ideal double")
    got = bidding.pid_replay(hours, ideal, 480.0).orderBy("hour").toPandas()
    spent = integral = prev = 0.0
    for h in range(24):
        error = 20.0 * (h + 1) - spent
        integral += error
        m = min(max(1 + (0.3 * error + 0.05 * integral + 0.1 * (error - prev)) / 48.0, 0.3), 2.0)
        prev, spent = error, spent + 10 * (h % 5) * m
        assert got["multiplier"][h] == pytest.approx(m) and got["spent"][h] == pytest.approx(spent)
    assert math.isclose(got["utilisation"][0], min(1.0, spent / 480))
