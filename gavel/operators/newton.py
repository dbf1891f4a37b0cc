"""Maximum-likelihood fits of a few parameters by Newton steps on sums that Spark takes: one small aggregate a step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A step's log-likelihood, its gradient and the upper triangle of its second derivatives, for a row, at given parameters.
Terms = Callable[[list[float]], tuple[Column, list[Column], list[Column]]]


@dataclass
class Fit:
    """Parameters, log-likelihood, steps taken, and the largest part of the gradient at the end for each unit of weight."""

    at: list[float]
    log_likelihood: float
    steps: int
    gradient: float

    @property
    def converged(self) -> bool:
        return self.gradient < 1e-7


def newton(rows: DataFrame, terms: Terms, start: list[float], weight: str = "n", most: int = 60) -> Fit:
    """The maximum over `rows`, each counted `weight` times. A step that doesn't raise the likelihood is halved; where the curve isn't concave, the gradient is followed."""
    k = len(start)

    def sums(at: list[float]) -> tuple[float, np.ndarray, np.ndarray, float]:
        value, first, second = terms(at)
        w = F.col(weight)
        got = rows.agg(F.sum(w * value), F.sum(w), *[F.sum(w * c) for c in (*first, *second)]).first()
        numbers = [float(x or 0.0) for x in got]
        h = np.zeros((k, k))
        h[np.triu_indices(k)] = numbers[2 + k :]
        return numbers[0], np.array(numbers[2 : 2 + k]), h + np.triu(h, 1).T, numbers[1]

    at, step = np.array(start, float), 0
    value, g, h, total = sums(at.tolist())
    while step < most and np.abs(g).max() >= 1e-9 * max(total, 1.0):
        concave = bool((np.linalg.eigvalsh(h) < 0).all())
        move = -np.linalg.solve(h, g) if concave else g / max(float(np.abs(h).sum()), 1e-12)
        move *= min(1.0, 2.0 / max(float(np.abs(move).max()), 1e-300))
        better = False
        while np.abs(move).max() >= 1e-9:
            step += 1
            new = sums((at + move).tolist())
            if np.isfinite(new[0]) and new[0] >= value:
                better = new[0] > value or float(np.abs(new[1]).max()) < float(np.abs(g).max())
                break
            move /= 2
        if not better:
            break
        at = at + move
        value, g, h, total = new
    return Fit(at.tolist(), value, step, float(np.abs(g).max()) / max(total, 1.0))
