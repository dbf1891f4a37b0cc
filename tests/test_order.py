"""Places, sums and quantiles of whole tables, on more rows than a range sample holds, with columns beside the keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.operators import features as f
from gavel.operators import order as o

N = 200_000


@pytest.fixture(scope="module")
def wide(spark):
    df = spark.range(N).select(F.col("id").alias("bidid"), (F.xxhash64("id") % 5000).cast("string").alias("timestamp"), F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") % 4).cast("int")).alias("advertiser"), F.repeat(F.lit("x"), 40).alias("payload"))
    return df.where("advertiser <> 3 or bidid % 2 = 0").cache()


def test_temporal_split_keeps_wide_rows(wide):
    n = wide.count()
    got = f.split_temporal(wide, ["timestamp", "bidid"])
    sizes = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    a, b = int(n * 0.7), int(n * 0.85)
    assert sizes == {"train": a, "val": b - a, "test": n - b}
    pdf = got.toPandas().sort_values(["timestamp", "bidid"])
    assert pdf["split"].tolist() == ["train"] * a + ["val"] * (b - a) + ["test"] * (n - b)
    assert set(got.columns) == {*wide.columns, "split"}


def test_split_by_group_of_a_hot_group(wide):
    pdf = f.split_by_group(wide, "advertiser", ["timestamp", "bidid"]).toPandas()
    for _, g in pdf.groupby("advertiser"):
        share = np.arange(len(g)) / len(g)
        want = np.where(share < 0.7, "train", np.where(share < 0.85, "val", "test"))
        assert g.sort_values(["timestamp", "bidid"])["split"].tolist() == want.tolist()


def test_tiny_and_empty_groups(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 2), (5, 2), (6, 2)], "bidid int, g int")
    got = {r["bidid"]: r["split"] for r in f.split_by_group(df, "g", ["bidid"]).collect()}
    assert got == {1: "train", 2: "train", 3: "train", 4: "train", 5: "train", 6: "train"}
    assert f.split_by_group(df.limit(0), "g", ["bidid"]).count() == 0 and f.split_temporal(df.limit(0), ["bidid"]).count() == 0


def test_places_and_lowest(spark, wide):
    got = o.add_place(wide.select("timestamp", "bidid"), ["timestamp", "bidid"], "at").toPandas().sort_values("at")
    assert got["at"].tolist() == list(range(len(got)))
    assert got.equals(got.sort_values(["timestamp", "bidid"]))
    h = F.xxhash64("bidid", F.lit(1))
    for n in (0, 1, 5_000, N * 2):
        low = {r[0] for r in o.lowest(wide, h, "bidid", n).select("bidid").collect()}
        assert low == {r[0] for r in wide.orderBy(h, "bidid").limit(n).select("bidid").collect()}


def test_quantiles_and_sums(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1e-3, 3000), rng.lognormal(0, 9, 3000), -rng.lognormal(0, 9, 500), np.zeros(200), np.ones(300)])
    k = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(k, x, strict=True)] + [(0, None)], "k int, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.995, 1.0]
    for r in o.quantiles(df, "v", qs, ("k",)).collect():
        assert r["edge"] == pytest.approx(np.quantile(x[k == r["k"]], r["q"]), rel=1e-12, abs=1e-15)
    assert {r["q"] for r in o.quantiles(df, "v", qs).collect()} == set(qs)
    counted = df.where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    for r in o.add_sums_before(counted, "v", ["n"], ("k",)).where("k = 1").limit(300).collect():
        assert r["n_before"] == ((k == 1) & (x < r["v"])).sum()


@pytest.mark.parametrize("literals", [1, 3, 7])
def test_bounds_of_very_many_ranges(spark, wide, monkeypatch, literals):
    """Bounds in two levels give the places that literals alone give, with nulls, ties and rows below none lost."""
    monkeypatch.setattr(o, "LITERALS", literals)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        keys = wide.where("bidid < 20000").select(F.when(F.col("bidid") % 11 > 0, F.col("timestamp")).alias("timestamp"), "bidid", "payload")
        got = o.add_place(keys, ["timestamp", "bidid"], "at")
        assert got.columns == ["timestamp", "bidid", "payload", "at"]
        pdf = got.toPandas().sort_values("at")
        assert pdf["at"].tolist() == list(range(keys.count()))
        assert list(zip(pdf["timestamp"], pdf["bidid"], strict=True)) == [(r[0], r[1]) for r in keys.orderBy("timestamp", "bidid").select("timestamp", "bidid").collect()]
        places = [0, 1, 777, len(pdf) - 1, len(pdf)]
        assert {k: (r["timestamp"], r["bidid"]) for k, r in o.rows_at(keys, ["timestamp", "bidid"], places).items()} == {k: (pdf["timestamp"].iloc[k], pdf["bidid"].iloc[k]) for k in places[:-1]}
        assert o.add_place(keys.limit(0), ["bidid"]).count() == 0 and o.rows_at(keys.limit(0), ["bidid"], [0]) == {}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_places_compare_rows_with_few_bounds(spark, wide, monkeypatch):
    """As many bounds as the ranges that hold the places have, however many ranges there are."""
    seen, with_range = [], o._with_range
    monkeypatch.setattr(o, "_with_range", lambda df, order, lows, starts: (seen.append(len(lows)), with_range(df, order, lows, starts))[1])
    keys = wide.select("timestamp", "bidid")
    rows = keys.orderBy("timestamp", "bidid").collect()
    n = len(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        for places in ([0], [n - 1], [int(n * 0.7), int(n * 0.85)], [0, 1, n // 2, n - 1]):
            assert {p: (r["timestamp"], r["bidid"]) for p, r in o.rows_at(keys, ["timestamp", "bidid"], places).items()} == {p: tuple(rows[p]) for p in places}
            assert seen.pop() <= 2 * len(places) + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
