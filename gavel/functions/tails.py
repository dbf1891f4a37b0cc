"""Scalar tails of distributions, for aggregates of a few clusters."""

from __future__ import annotations

import math


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_quantile(p: float) -> float:
    """By bisection on erfc."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def t_cdf(t: float, df: float, steps: int = 4000) -> float:
    """By Simpson's rule on the angle, t = sqrt(df) tan(u)."""
    end = math.atan(t / math.sqrt(df))
    h = end / steps
    total = 1.0 + math.cos(end) ** (df - 1)
    for i in range(1, steps):
        total += (4 if i % 2 else 2) * math.cos(i * h) ** (df - 1)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 0.5 + scale * total * h / 3


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def binomial_upper(k: int, n: int) -> float:
    """P(X >= k) of n fair coins."""
    return sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n


def ks_p(d: float, n: float) -> float:
    """Asymptotic two-sided Kolmogorov-Smirnov tail for an effective size n."""
    x = d * (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) if n > 0 else 0.0
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))
