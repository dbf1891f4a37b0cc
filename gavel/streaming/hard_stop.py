"""The state of a campaign day's budget."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

_DAY_MS = 86_400_000
#: A bid that waits: its time in microseconds, its id and its cost.
_BID = np.dtype([("at", "i8"), ("bidid", "i8"), ("cost", "f8")])


def _packed(frame: pd.DataFrame) -> np.ndarray:
    if any(frame[c].hasnans for c in _BID.names):
        raise ValueError("a paid bid needs a time, an id and a cost")
    bids = np.empty(len(frame), _BID)
    for c in _BID.names:
        bids[c] = frame[c].to_numpy()
    return bids


class BudgetGate(StatefulProcessor):
    """Takes a campaign day's bids in the order of (ts, bidid) once the watermark has passed them, until the budget is used up.

    State: what is spent and whether the day is closed, and the bids that wait, as one value for each Arrow batch of
    them, so that the calls to the state store grow with days and batches and not with bids. Timers: at the earliest
    bid of each batch and of those left, and at the day's end, where all state goes; one that finds nothing due does
    nothing. The key's day and the bids' times are microseconds.
    """

    OUTPUT = "advertiser int, day long, bidid long, cost double, spent double, accepted int"

    def __init__(self, budget: float) -> None:
        self.budget = budget

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "spent double, closed boolean")
        self.waiting = handle.getListState("waiting", "bids binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [_packed(frame) for frame in rows if len(frame)]
        if new:
            self.waiting.appendList([(bids.tobytes(),) for bids in new])
            self.handle.registerTimer(int(min(bids["at"].min() for bids in new)) // 1000)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed, end = timerValues.getCurrentWatermarkInMs(), int(key[1]) // 1000 + _DAY_MS
        held = np.concatenate([np.empty(0, _BID), *(np.frombuffer(bytes(bids), _BID) for (bids,) in self.waiting.get())])
        is_due = held["at"] // 1000 <= passed
        due, rest = held[is_due], held[~is_due]
        if not len(due) and passed < end:
            return iter([])
        out = []
        spent, closed = tuple(self.total.get() or (0.0, False)) if len(due) else (0.0, False)
        if len(due):
            due = due[np.lexsort((due["cost"], due["bidid"], due["at"]))]
            sums = np.cumsum(np.concatenate([[spent], due["cost"]]))
            over = np.flatnonzero(sums[1:] > self.budget)
            taken = 0 if closed else int(over[0]) if len(over) else len(due)
            closed, spent = closed or taken < len(due), float(sums[taken])
            place = np.arange(1, len(due) + 1)
            out.append(pd.DataFrame({"advertiser": key[0], "day": key[1], "bidid": due["bidid"], "cost": due["cost"], "spent": sums[np.minimum(place, taken)], "accepted": (place <= taken).astype("int32")}))
        if len(rest) or passed < end:
            self.total.update((spent, closed))
            self.waiting.put([(rest.tobytes(),)]) if len(rest) else self.waiting.clear()
            self.handle.registerTimer(int(rest["at"].min()) // 1000 if len(rest) else end)
        else:
            self.total.clear()
            self.waiting.clear()
        return iter(out)

    def close(self) -> None:
        """Nothing is held outside the state."""
