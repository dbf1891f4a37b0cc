"""Streams whose rows arrive in parts, over restarts from the checkpoint, against what a plain loop gives."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from gavel.streaming import jobs as j

START = datetime(2024, 3, 1)


def gate_by_hand(rows, parts, delay, budget):
    """(bidid, spent, accepted) of what the watermark has passed, and how many bids came behind it."""
    taken, late, top = [], 0, None
    for k in range(parts):
        mark = top - delay if top else None
        arrived = [r for r in rows if r[0] == k]
        for r in arrived:
            if mark and r[1] <= mark:
                late += 1
            else:
                taken.append(r)
        top = max([x for x in (top, *(r[1] for r in arrived)) if x], default=None)
    out, spent, closed = {}, {}, set()
    for _, ts, bidid, advertiser, cost in sorted(taken, key=lambda r: (r[1], r[2])):
        if ts <= top - delay:
            day = (advertiser, ts.date())
            if spent.get(day, 0) + cost > budget:
                closed.add(day)
            if day not in closed:
                spent[day] = spent.get(day, 0) + cost
            out[bidid] = (spent.get(day, 0.0), int(day not in closed))
    return out, late


def test_hard_stop_by_hand(spark):
    rng = np.random.default_rng(8)
    rows, parts = [], 5
    for i in range(400):
        ts = START + timedelta(minutes=int(rng.integers(0, 6 * 1440 // 10)) * 10)
        part = min(parts - 1, int((ts - START) / timedelta(days=6) * parts) + int(rng.choice([0, 0, 0, 1, 2])))
        rows.append((part, ts, i, int(rng.integers(1, 4)), float(rng.choice([0.0, 5.0, 10.0, 25.0]))))
    rows.append((0, START, 1000, 9, 100.0))  # uses the budget up to the last cent
    rows.append((0, START, 1001, 9, 0.0))
    rows.append((0, START, 1002, 9, 1.0))
    rows.append((0, START, 1003, 9, 0.0))  # would fit, but the day is closed
    df = spark.createDataFrame(rows, "part int, ts timestamp, bidid long, advertiser int, cost double")
    got, marks = j.replay(df, lambda s: j.hard_stop(s, 100.0, "1 day"), "stop", parts, j.STATE_STORE)
    want, late = gate_by_hand(rows, parts, timedelta(days=1), 100.0)
    assert {r.bidid: (r.spent, r.accepted) for r in got.collect()} == want
    assert [want[i] for i in (1000, 1001, 1002, 1003)] == [(100.0, 1), (100.0, 1), (100.0, 0), (100.0, 0)]
    assert late > 0 and {0, 1} == {a for _, a in want.values()}
    assert marks.count() == parts and marks.where("watermark is not null").count() == parts
    assert j.late_rows(df, marks, F.col("ts")).agg(F.sum("late")).first()[0] == late
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != j.STATE_STORE["spark.sql.streaming.stateStore.providerClass"]


def test_a_session_over_parts_is_one(spark):
    at = [(0, 0), (0, 20), (1, 40), (2, 60), (2, 200), (3, 800), (4, 1500)]
    df = spark.createDataFrame([(k, START + timedelta(minutes=m), 7) for k, m in at], "part int, ts timestamp, user long")
    got, _ = j.replay(df, lambda s: j.sessions(s, "user", "30 minutes", "10 minutes"), "sessions", 5)
    assert sorted((r.n, int((r.end - r.start).total_seconds() // 60)) for r in got.collect()) == [(1, 30), (1, 30), (4, 90)]


def test_late_rows_are_in_no_window(spark):
    rows = [(0, 0, 1), (0, 300, 1), (1, 10, 1), (1, 400, 1), (2, 330, 1), (2, 900, 1), (3, 30, 1)]
    df = spark.createDataFrame([(k, START + timedelta(minutes=m), 1, w, 0, 50) for k, m, w in rows], "part int, ts timestamp, adexchange int, win int, click int, payprice int")
    got, marks = j.replay(df, lambda s: j.kpis(s, ["adexchange"], "1 hour", late="2 hours"), "kpis", 5)
    closed = sorted((r.start, r.n) for r in got.collect())
    hour = lambda h: START + timedelta(hours=h)
    assert closed == [(hour(0), 1), (hour(5), 2), (hour(6), 1)]
    end = F.date_trunc("hour", "ts") + F.expr("interval 1 hour")
    assert [(r.part, r.n, r.late) for r in j.late_rows(df, marks, end).orderBy("part").collect()] == [(0, 2, 0), (1, 2, 1), (2, 2, 0), (3, 1, 1)]


def test_empty_arrivals(spark):
    df = spark.createDataFrame([], "ts timestamp, bidid long, advertiser int, cost double")
    got, marks = j.replay(j.arrivals(df, 2, F.lit(0)), lambda s: j.hard_stop(s, 1.0), "stop", 2, j.STATE_STORE)
    assert got.count() == 0 and marks.count() == 2
