"""The paced auction in rounds against a loop over each campaign day."""

import numpy as np
import pytest

from gavel.operators.bidding import MAX_BID, paced_auction


def by_hand(rows, ideal, budget, kp=0.3, ki=0.05, kd=0.1):
    out = []
    for key in sorted({r[:2] for r in rows}):
        own = [r for r in rows if r[:2] == key]
        spent = integral = prev = 0.0
        wins = clicks = 0
        for hour in range(24):
            error = ideal[hour] - spent
            integral += error
            m = min(max(1 + (kp * error + ki * integral + kd * (error - prev)) / max(0.1 * budget, 1.0), 0.3), 2.0)
            prev, start, run = error, spent, 0.0
            for _, _, _, _, v, price, click in sorted((r for r in own if r[2] == hour), key=lambda r: r[3]):
                bid = min(v * m, MAX_BID)
                if bid >= price:
                    run += bid
                    if start + run <= budget:
                        spent, wins, clicks = spent + bid, wins + 1, clicks + click
        out.append((*key, round(spent, 6), wins, clicks))
    return out


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_rounds_are_the_replay(spark, block):
    rng = np.random.default_rng(block)
    rows = [(int(rng.choice([1, 1, 1, 2, 3])), int(rng.integers(1, 3)), int(rng.integers(0, 24)), i, float(rng.uniform(5, 200)), int(rng.integers(1, 150)), int(rng.random() < 0.3)) for i in range(1500)]
    ideal = {h: 6000.0 * (h + 1) / 24 for h in range(24)}
    df = spark.createDataFrame(rows, "advertiser int, day long, hour int, bidid long, v double, payprice int, click int").repartition(4)
    got = paced_auction(df, ideal, 6000.0, block=block).collect()
    assert sorted((r.advertiser, r.day, round(r.spent, 6), r.wins, r.clicks) for r in got) == by_hand(rows, ideal, 6000.0)
    assert len({r.wins for r in got}) > 2 and max(r.spent for r in got) > 5000


def test_no_bids(spark):
    df = spark.createDataFrame([], "advertiser int, day long, hour int, bidid long, v double, payprice int, click int")
    assert paced_auction(df, dict.fromkeys(range(24), 1.0), 10.0).count() == 0
