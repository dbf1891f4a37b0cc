"""Bootstrap replicates, and Python functions as arguments."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gavel.operators import bidding, debias, explore
from gavel.streaming import jobs


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(0.2, 3.0, 4_000)
    return d, spark.createDataFrame(pd.DataFrame({"bidid": np.arange(4_000), "a": d, "b": 0.0})).repartition(5)


def test_replicates_are_poisson_sums(spark, gaps):
    d, df = gaps
    reps = bidding.replicate_sums(df, "a", "b", 800).toPandas()
    assert len(reps) == 800 and sorted(reps["rep"]) == list(range(800))
    se = np.sqrt((d**2).sum())
    assert reps["gap"].mean() == pytest.approx(d.sum(), abs=4 * se / 800**0.5)
    assert reps["gap"].std() == pytest.approx(se, rel=0.1)
    again = bidding.replicate_sums(df.repartition(2), "a", "b", 800).orderBy("rep").toPandas()
    assert np.allclose(again["gap"], reps.sort_values("rep")["gap"])
    one = bidding.replicate_sums(df.limit(1), "a", "b", 4_000).toPandas()["gap"]
    counts = (one / one[one != 0].abs().min()).abs().round()
    assert [(counts == k).mean() for k in range(3)] == pytest.approx([0.368, 0.368, 0.184], abs=0.03)


def test_the_normal_limit_agrees_with_the_replicates(spark, gaps):
    d, df = gaps
    exact = bidding.replicate_interval(bidding.replicate_sums(df, "a", "b", 800)).first()
    limit = bidding.paired_bootstrap(df, "a", "b", 800, heavy=100).first()
    se = np.sqrt((d**2).sum())
    for c in ("ci_lo", "ci_hi"):
        assert exact[c] == pytest.approx(limit[c], abs=0.3 * se)
    assert exact["p_positive"] == pytest.approx(limit["p_positive"], abs=0.02) and exact["se"] == pytest.approx(limit["se"], rel=0.12)


def test_tag_rows(spark):
    df = spark.createDataFrame([(1, "10, 7"), (2, None), (3, ""), (4, "1,x"), (5, "5")], "bidid long, usertag string")
    assert sorted(map(tuple, explore.tag_rows(df).collect())) == [(1, 0, 10), (1, 1, 7), (5, 0, 5)]


def test_reducers_get_counted_values(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 5), (2, 7), (2, None), (3, None)], "k int, v int")
    got = explore.reduce_counts(df, ["k"], "v", {"mean": lambda v, n: float((v * n).sum() / n.sum()), "kinds": lambda v, n: float(len(v))})
    assert sorted(map(tuple, got.collect())) == [(1, 3.0, 2.0), (2, 7.0, 1.0)]


def test_decisions_without_a_curve(spark):
    """A bid on an unknown exchange is its value, of unknown chance; a known one's chance is read from the curve between whole prices."""
    grid = [float(min(i, 100)) / 100 for i in range(301)]
    markets = spark.createDataFrame([(1, [0.0], [30.0], grid)], "adexchange int, breaks array<double>, best array<double>, cdf_grid array<double>")
    rows = spark.createDataFrame([(1, 1, 0.02, 0), (2, 9, 0.01, 0), (3, 1, 0.0201, 50)], "bidid long, adexchange int, p_a double, slotprice int")
    got = {r.bidid: r for r in jobs.decide(rows, markets, 2_000.0).collect()}
    assert (got[1].v, got[1].bid, got[1].win_prob, got[1].regime, got[1].curve) == (40.0, 30.0, 0.3, 0, "1")
    assert (got[2].bid, got[2].win_prob, got[2].curve) == (20.0, None, "none")
    assert got[3].regime == 1 and got[3].bid == pytest.approx(40.2) and got[3].win_prob == pytest.approx(0.402)
    model = debias.LinearProbability(["slotprice"], [0.0], [0.1], -4.0)
    got = {r.bidid: r.pctr for r in jobs.decide(rows.withColumn("slotprice", F.when(F.col("bidid") != 2, F.col("slotprice"))), markets, 2_000.0, model).collect()}
    assert got[3] == pytest.approx(1 / (1 + np.exp(-1))) and np.isnan(got[2])
