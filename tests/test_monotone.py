"""Monotone maps by ranges against pooling in one list."""

import numpy as np
import pandas as pd
import pytest

from gavel.operators import metrics, monotone


def pooled(x, s, w):
    """(lo, hi, mean) of all cells pooled in one list."""
    held = []
    for a, b, c in zip(x, s, w, strict=True):
        held.append([a, a, b, c])
        while len(held) > 1 and held[-2][2] / held[-2][3] >= held[-1][2] / held[-1][3]:
            z = held.pop()
            held[-1] = [held[-1][0], z[1], held[-1][2] + z[2], held[-1][3] + z[3]]
    return [(a, b, round(c / d, 9)) for a, b, c, d in held]


def shape(kind, rng, n=300):
    x = np.sort(rng.choice(10_000, n, replace=False)) / 10_000
    mean = {"rising": x, "falling": 1 - x, "noise": np.full(n, 0.3), "saw": np.mod(np.arange(n), n // 3) / n, "steps": np.floor(x * 5) / 5, "two": np.where(np.arange(n) < n // 2, x, x - x.max() / 2)}[kind]
    w = rng.integers(1, 9, n).astype(float)
    return x, np.clip(mean + rng.normal(0, 0.1, n), 0, 1) * w, w


@pytest.mark.parametrize(("parts", "fan"), [(1, 2), (7, 2), (9, 3), (8, 16)])
def test_blocks_of_ranges_are_those_of_one_list(spark, parts, fan):
    rng = np.random.default_rng(parts)
    cells, want = [], {}
    for kind in ("rising", "falling", "noise", "saw", "steps", "two"):
        x, s, w = shape(kind, rng)
        cells += [(kind, *map(float, r)) for r in zip(x, s, w, strict=True)]
        want[kind] = pooled(x, s, w)
    df = spark.createDataFrame(cells, "kind string, x double, s double, w double").repartition(5)
    got = monotone.blocks(df, ["kind"], parts, fan).collect()
    for kind, blocks in want.items():
        assert sorted((r.lo, r.hi, round(r.s / r.w, 9)) for r in got if r.kind == kind) == blocks


@pytest.mark.parametrize("parts", [1, 6])
def test_values_are_linear_between_blocks(spark, parts):
    rng = np.random.default_rng(3)
    x, s, w = shape("rising", rng, 60)
    held = pooled(x, s, w)
    ask = np.concatenate([rng.uniform(-0.2, 1.2, 200), x[::7], [x[0], x[-1]]])
    cells = spark.createDataFrame(pd.DataFrame({"x": x, "s": s, "w": w}))
    points = spark.createDataFrame(pd.DataFrame({"x": ask}))
    got = {r.x: r.g for r in monotone.values(points, monotone.blocks(cells, [], parts), [], parts).collect()}
    ends = np.array([e for b in held for e in b[:2]])
    value = np.repeat([b[2] for b in held], 2)
    for a in ask:
        assert got[a] == pytest.approx(np.interp(a, ends, value), abs=1e-8)


def test_weights_nulls_and_empty_tables(spark):
    rows = [(1, 0.2, 1, 1.0), (2, 0.4, 0, 3.0), (3, 0.6, 1, 0.0), (4, None, 1, 1.0), (5, float("nan"), 0, 1.0), (6, 0.8, 1, 2.0)]
    df = spark.createDataFrame(rows, "bidid long, p double, click int, wt double")
    got = {r.bidid: r.calibrated for r in metrics.isotonic(df, df, weight="wt").collect()}
    assert got[1] == got[2] == pytest.approx(0.25) and got[6] == 1.0
    assert got[3] == pytest.approx(0.625) and got[4] is None and got[5] is None
    none = df.where("1 = 0")
    assert [r.calibrated for r in metrics.isotonic(none, df).collect()] == [None] * 6 and metrics.isotonic(df, none).count() == 0


def test_ranks_stay(spark):
    """A calibrated score never falls as the score rises, and its mean is the label's on the rows of the fit."""
    rng = np.random.default_rng(12)
    p = rng.random(2_000).round(3)
    y = (rng.random(2_000) < p**2).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"bidid": range(2_000), "p": p, "click": y}))
    got = metrics.isotonic(df, df).orderBy("p").toPandas()
    assert (np.diff(got["calibrated"]) >= -1e-12).all() and got["calibrated"].mean() == pytest.approx(y.mean())
