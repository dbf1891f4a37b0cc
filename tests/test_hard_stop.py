"""The budget gate's calls to its state, by a stand-in that counts them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gavel.streaming import jobs as j
from gavel.streaming.hard_stop import BudgetGate

DAY = 19_000 * 86_400_000_000


class Store:
    """Handle, value state, list state and watermark in one; `sent` counts values that go to or come from the list."""

    def __init__(self):
        self.value, self.rows, self.timers, self.sent, self.passed = None, [], [], 0, 0

    def getValueState(self, name, schema):
        return type("Value", (), {"get": lambda _: self.value, "update": lambda _, v: setattr(self, "value", v), "clear": lambda _: setattr(self, "value", None)})()

    def getListState(self, name, schema):
        return self

    def appendList(self, rows):
        self.rows, self.sent = self.rows + list(rows), self.sent + len(rows)

    def put(self, rows):
        self.rows = []
        self.appendList(rows)

    def get(self):
        self.sent += len(self.rows)
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.passed


def fire(gate, store, passed):
    store.passed = passed
    return [r for frame in gate.handleExpiredTimer((7, DAY), store, None) for r in frame[["bidid", "spent", "accepted"]].itertuples(index=False, name=None)]


def frame(at, bidid, cost):
    return pd.DataFrame({"at": np.asarray(at, "i8") + DAY, "bidid": np.asarray(bidid, "i8"), "cost": np.asarray(cost, "f8")})


def test_bids_go_to_the_state_in_few_values():
    """A campaign day's calls to the state don't grow with its bids."""
    n, rng = 20_000, np.random.default_rng(3)
    at, cost = rng.integers(0, 86_400, n) * 1_000_000, rng.choice([0.0, 0.1, 5.0], n)
    gate, store = BudgetGate(20_000.0), Store()
    gate.init(store)
    assert list(gate.handleInputRows((7, DAY), iter([frame(at[:9000], range(9000), cost[:9000]), frame(at[9000:], range(9000, n), cost[9000:])]), store)) == []
    half = DAY // 1000 + 43_200_000
    got = fire(gate, store, half) + fire(gate, store, half + 1000 * 86_400)
    assert store.sent <= 6 and not store.rows and store.value is None
    spent, closed, want = 0.0, False, []
    for k in sorted(range(n), key=lambda k: (at[k], k)):
        closed = closed or spent + cost[k] > 20_000.0
        spent += 0.0 if closed else cost[k]
        want.append((k, spent, int(not closed)))
    assert got == want and {0, 1} == {a for _, _, a in got}


def test_a_closed_day_stays_closed_over_timers():
    gate, store = BudgetGate(10.0), Store()
    gate.init(store)
    list(gate.handleInputRows((7, DAY), iter([frame([3_000_000, 1_000_000, 2_000_000], [3, 1, 2], [1.0, 10.0, 0.5])]), store))
    assert store.timers == [DAY // 1000 + 1000]
    assert fire(gate, store, DAY // 1000 + 2000) == [(1, 10.0, 1), (2, 10.0, 0)]
    assert store.timers[-1] == DAY // 1000 + 3000
    assert fire(gate, store, DAY // 1000 + 3000) == [(3, 10.0, 0)]
    assert fire(gate, store, DAY // 1000 + 3000) == [] and store.value == (10.0, True)
    assert fire(gate, store, DAY // 1000 + 86_400_000) == [] and store.value is None


def test_a_bid_without_a_cost_is_refused_aloud():
    gate, store = BudgetGate(10.0), Store()
    gate.init(store)
    with pytest.raises(ValueError):
        list(gate.handleInputRows((7, DAY), iter([frame([1], [1], [float("nan")])]), store))


def test_arriving_rows_are_stored_once(spark, tmp_path):
    spark.range(90).select(F.col("id").alias("bidid"), F.timestamp_seconds(F.col("id") * 86_400).alias("ts")).write.parquet(str(tmp_path / "rows"))
    got = j.arrivals(spark.read.parquet(str(tmp_path / "rows")), 3, F.lit(0))
    assert all("arriving-" in f for f in got.inputFiles()) and got.groupBy("part").count().where("count = 30").count() == 3
